import hashlib
import random

import numpy as np
import pytest

from weft.llm import mixing as m

SCHEMA = "doc_id long, text string, lang string, source string, prob string, __weft_tokens int"


def corpus(n=3000, seed=2, longest=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", None])
        lang = rng.choice(["en", "en", "fr"])
        text = " ".join(["word"] * rng.randint(1, 30)) + rng.choice(["", "\nx", " %%%" * 40, " and more" * longest])
        rows.append((i, text, lang, source, "p", 1))
    return rows


def test_raked_marginals_meet_their_targets():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, k, 60) for k in (4, 3, 2)]
    tokens = rng.integers(1, 1000, 60)
    goals = [np.full(k, 1 / k) for k in (4, 3, 2)]
    w = m.rake(codes, tokens, goals, 60)
    for code, goal in zip(codes, goals):
        assert np.bincount(code, w, len(goal)) / tokens.sum() == pytest.approx(goal, abs=1e-6)


@pytest.mark.parametrize("targets", [None, m.TARGETS, {"source": {"a": 0.2, "b": 0.5, "absent": 0.3}, "lang": {"fr": 0.6, "en": 0.4}}])
def test_sample_equals_brute_force(spark, targets):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marks = set("!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~")
    topic = lambda t: "noise" if sum(c in marks for c in t) * 3 > len(t) else "long" if len(t.split()) >= 400 else "short"
    cell = {r[0]: (r[3], r[2], topic(r[1])) for r in rows}
    size = {r[0]: len(r[1].split()) for r in rows}
    cells = sorted(set(cell.values()), key=str)
    t = {c: sum(size[i] for i in cell if cell[i] == c) for c in cells}
    total = sum(t.values())
    goals = []
    for d, name in enumerate(m.DIMS):
        sums = {v: sum(t[c] for c in cells if c[d] == v) for v in {c[d] for c in cells}}
        raw = {v: targets[name].get(v, 0) if targets and name in targets else (s / total) ** m.TEMPERATURE for v, s in sums.items()}
        goals.append({v: x / sum(raw.values()) * total for v, x in raw.items()})
    w = {c: float(t[c]) for c in cells}
    for _ in range(m.ROUNDS):
        for d in range(3):
            now = {v: sum(w[c] for c in cells if c[d] == v) for v in goals[d]}
            w = {c: w[c] * goals[d][c[d]] / now[c[d]] if now[c[d]] else 0 for c in cells}
    factor = {c: w[c] / t[c] for c in cells}
    top = max(factor.values())
    u = lambda i: int(hashlib.md5(f"{i}:0".encode()).hexdigest()[:12], 16) / 16**12
    expected = {i for i in cell if u(i) < factor[cell[i]] / top}
    assert {r.doc_id for r in m.mix(df, targets).collect()} == expected
    assert {r.doc_id for r in m.mix(df, targets, max_cells=0).collect()} == expected
    if targets and "source" in targets:
        kept = [i for i in expected if cell[i][0] == "b"]
        assert sum(size[i] for i in kept) / sum(size[i] for i in expected) == pytest.approx(0.5 / 0.7, abs=0.08)


def test_nulls_repeats_empty_texts_and_columns(spark):
    rows = [(1, None, None, None, "x", 1), (1, None, None, None, "x", 1), (None, "a b", "en", "s", "x", 2), (2, "", "en", "t", "x", 3), (3, "w " * 400_000, "en", "s", "x", 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = m.mix(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sum(r.doc_id == 1 for r in got) == 2 and any(r.doc_id == 2 for r in got)
    assert {r.topic for r in m.mix(df, report=True).where("doc_id = 1").collect()} == {"none"}
    assert m.mix(df.limit(0)).collect() == [] and m.mix(df.limit(0), max_cells=-1).collect() == []


def test_a_stray_document_does_not_set_the_scale(spark):
    rows = corpus(longest=1)
    stray = (9999, " ".join(["w"] * 10), None, "a", "p", 1)
    size = lambda got: sum(len(r.text.split()) for r in got)
    kept = {}
    for name, data in (("plain", rows), ("stray", [*rows, stray])):
        df = spark.createDataFrame(data, SCHEMA).repartition(4)
        for cells in (m.MAX_CELLS, 0):
            got = m.mix(df, negligible=m.NEGLIGIBLE, max_cells=cells).collect()
            kept[name, cells] = {r.doc_id for r in got}, size(got)
        assert kept[name, 0] == kept[name, m.MAX_CELLS]
    assert kept["stray", 0][1] > 0.95 * kept["plain", 0][1] and 9999 in kept["stray", 0][0]
    assert size(m.mix(spark.createDataFrame([*rows, stray], SCHEMA)).collect()) < 0.8 * kept["stray", 0][1]


def test_shares_stay_within_the_bound_of_negligible_cells():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 5, 200)
    tokens, fitted = rng.integers(1, 10**6, 200).astype(float), rng.integers(1, 10**6, 200).astype(float)
    for negligible in (0.0, 0.01, 0.2):
        factor = fitted / tokens
        top = m.scale(factor, fitted, negligible)
        kept = tokens * np.minimum(1, factor / top)
        assert fitted[factor > top].sum() <= negligible * fitted.sum()
        off = np.bincount(code, kept) / kept.sum() - np.bincount(code, fitted) / fitted.sum()
        assert abs(off).max() <= negligible / (1 - negligible) + 1e-12
    assert m.scale(factor, fitted, 0.0) == factor.max()
