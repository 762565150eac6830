import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from weft.llm import common
from weft.llm import simhash_dedup as s


def brute_signs(hashes, n_bits):
    sums = [0] * n_bits
    for h in hashes:
        bits = []
        for k in range(1, n_bits // 64 + 1):
            z = (h + k * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
            z ^= z >> 31
            bits += [(byte >> (7 - i)) & 1 for byte in z.to_bytes(8, "little") for i in range(8)]
        sums = [a + 2 * b - 1 for a, b in zip(sums, bits)]
    return [int(x > 0) for x in sums]


def brute_print(text):
    words = [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+", (text or "").lower())]
    runs = set()
    for i in range(max(1, len(words) - 2)):
        h = 0
        for w in words[i : i + 3]:
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + w) % 2**64
        runs.add(h)
    return brute_signs(set(words), s.BITS) + brute_signs(runs, s.SHINGLE_BITS)


def groups_of(prints, pairs):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in prints}


def corpus(seed=4, families=25):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    rows, i = [], 0
    for _ in range(families):
        base = rng.choices(vocab, k=rng.randint(3, 300))
        for copy in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(min(copy, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((i, " ".join(words)))
            i += 1
    return rows


def test_fingerprint_is_simhash():
    for text in ["one", "One two two, three", "é à ü", " ".join(f"w{i}" for i in range(900))]:
        assert np.unpackbits(s.fingerprint(text)).tolist() == brute_print(text)
    assert s.fingerprint(None) is s.fingerprint("") is s.fingerprint("!! \n") is None


def distances(prints):
    """Of all pairs of prints: (a, b, word bits, bits of the lanes, shingle bits, whether a lane is within the radius)."""
    lanes = {i: s.lanes_of(p[None, :])[0] for i, p in prints.items()}
    at = s.BITS // 8
    for a in prints:
        for b in prints:
            if a < b:
                apart = np.bitwise_count(prints[a] ^ prints[b])
                yield a, b, apart[:at].sum(), apart[: s.LANES * s.LANE_BITS // 8].sum(), apart[at:].sum(), (np.bitwise_count(lanes[a] ^ lanes[b]) <= 2).any()


@pytest.mark.parametrize("block", [2, 4096])
def test_groups_equal_brute_force_over_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", block)
    rows = corpus() + [(900, None), (901, ""), (902, "")]
    prints = {i: s.fingerprint(t) for i, t in rows if t}
    found = list(distances(prints))
    near = [x for x in found if x[2] <= s.MAX_DISTANCE and x[4] <= s.SHINGLE_DISTANCE]
    met = [x for x in near if x[5]]
    assert all(x[5] for x in found if x[3] <= 29)  # sure to meet
    assert len(near) > 40 and len(met) / len(near) >= 0.9
    expected = groups_of(prints, [x[:2] for x in met]) | {900: 900, 901: 901, 902: 902}
    df = spark.createDataFrame([*rows, rows[0], (None, rows[0][1])], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.group_id for r in s.near_groups(df).collect()}
    assert got == expected


@pytest.mark.parametrize("block", [3, 4096])
def test_every_pair_within_the_radius_of_a_lane_meets(spark, block):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (s.BITS + s.SHINGLE_BITS) // 8, dtype=np.uint8)
    rows = [(0, bytes(base))]
    for i in range(1, 40):  # two flips in one lane, many in all others
        bits = np.unpackbits(base)
        lane = i % s.LANES
        for other in range(s.LANES):
            at = other * s.LANE_BITS + rng.permutation(s.LANE_BITS)[: 2 if other == lane else 4]
            bits[at] ^= 1
        rows.append((i, bytes(np.packbits(bits))))
    edges = s.near_edges(spark.createDataFrame(rows, "id long, print binary"), max_distance=s.BITS, block=block).collect()
    assert set(groups_of(dict(rows), [(e.a, e.b) for e in edges]).values()) == {0}


def test_long_texts_over_one_vocabulary_are_not_copies(spark):
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(vocab, k=20_000)) for _ in range(4)]
    prints = [s.fingerprint(t) for t in texts]
    assert np.bitwise_count(prints[0] ^ prints[1])[: s.BITS // 8].sum() <= s.MAX_DISTANCE  # their words are the same
    rows = [*enumerate(texts), (9, texts[0] + " and a little more")]
    got = s.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.group_id for r in got.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0}


def test_drop_near_keeps_leaders_and_columns(spark):
    rows = [(i, t, "x", i) for i, t in corpus(5)] + [(None, "no id", "x", 1), (700, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_id string, __weft_gone int").repartition(3)
    kept = s.drop_near(df)
    assert kept.columns == df.columns
    leaders = {r.group_id for r in s.near_groups(df).collect()} | {None}
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(leaders) and set(got) == leaders


def test_empty_table_and_very_long_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_groups(df).collect() == [] and s.drop_near(df).collect() == []
    long = " ".join(f"word{i % 5000}" for i in range(300_000))
    got = s.near_groups(spark.createDataFrame([(3, long), (2, long + " extra"), (9, "short")], "doc_id long, text string"))
    assert {r.doc_id: r.group_id for r in got.collect()} == {2: 2, 3: 2, 9: 9}


@pytest.mark.parametrize("block", [4, 4096])
def test_sets_that_straddle_batches(block):
    rng = np.random.default_rng(1)
    v = np.sort(np.concatenate([rng.integers(0, 40, 150), np.full(50, 7)]))
    r = np.arange(200)
    whole = {k: tuple(r[v == k]) for k in set(v.tolist()) if (v == k).sum() > 1}
    for size in (1, 3, 50, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(v[i : i + size]), pa.array(r[i : i + size])], names=["variant", "rep"]) for i in range(0, 200, size)]
        small, hot = set(), {}
        for b in s._met(block)(batches):
            for variant, members in zip(*(c.to_pylist() for c in b.columns)):
                assert len(members) <= block
                if variant is None:
                    small.add(tuple(members))
                else:
                    hot.setdefault(variant, []).append(members)
        assert small == {x for x in whole.values() if len(x) <= block}
        assert {k: tuple(sum(x, [])) for k, x in hot.items()} == {k: x for k, x in whole.items() if len(x) > block}


def test_components_raise_unless_they_converge(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    with pytest.raises(RuntimeError, match="converge"):
        common.components(chain, rounds=1)
    assert {r.root for r in common.components(chain).collect()} == {0}
