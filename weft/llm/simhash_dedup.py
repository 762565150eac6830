"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text has two fingerprints: the SimHash of its set of lower-case words (384 bits, the signs of the sums of the words'
hashes), and that of its set of 3-word shingles (256 bits), which holds the order of the words. The first 360 bits of the
former are read as ten lanes of 36. Within a lane every fingerprint emits its ball of half the radius: the lane itself and
each variant with one bit flipped. Two lanes within the radius of 2 share a variant - the meeting point halfway - so a
shuffle on (lane, variant) brings them together. The sets of fingerprints that met are deduplicated, and every met pair
is verified: near-duplicates differ in at most ``max_distance`` of the word bits and SHINGLE_DISTANCE of the shingle
bits. Word sets alone take any two long texts over one vocabulary for copies; half of the shingle bits of such differ.

What is near, then: texts that verify and lie within 2 bits in some lane. All such pairs are linked. Texts that differ
in at most 29 of the 360 bits always do, by the pigeonhole principle; of those further apart the share falls with
the distance (README). One word in thirty replaced already moves 64 bits by about five, and a ball of half of that
radius on 64 bits has 2,081 variants and more; ten lanes emit 370. LANE_BITS is the parameter of scale: a bit more
halves the chance meetings.

Documents with equal fingerprints are folded before they emit, so a text with many copies emits once. Groups are
the connected components of verified pairs: those that met are compared all with all, and leave a spanning forest of
the verified pairs, which has the same components. A variant of more than ``BLOCK`` fingerprints is cut into blocks of
that many, and its pairs of blocks are compared as sets of their own, in tasks of their own; none is left out.

Defined results: null texts, and texts without a word, are near nothing; equal texts are at distance 0; rows that
share an identifier are one document; a null identifier belongs to no group; an empty table gives no rows. Identifiers
are integers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, components, named, stored

LANES, LANE_BITS, BITS = 10, 36, 384
SHINGLE, SHINGLE_BITS = 3, 256
#: Sets of shingles that share three tenths of their union differ in about as many bits, unrelated ones in 128.
MAX_DISTANCE, SHINGLE_DISTANCE = 56, 88
BLOCK = 4096
WORD = re.compile(r"\w+")
_STEPS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _spread(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits) bits of 64-bit hashes, each extended by a splitmix generator."""
    z = hashes[:, None] + _STEPS[None, : bits // 64]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.unpackbits(z.view(np.uint8).reshape(len(hashes), -1), axis=1)


def _signs(hashes: np.ndarray, bits: int) -> np.ndarray:
    total = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 255):  # 255 ones fit a byte, which sums fastest
        total += np.add.reduce(_spread(hashes[i : i + 255], bits), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes))


def shingles(sequence: np.ndarray) -> np.ndarray:
    """Distinct hashes of the runs of SHINGLE words of a sequence of word hashes; a shorter sequence is one run."""
    run = np.zeros(max(1, len(sequence) - SHINGLE + 1), np.uint64)
    for k in range(min(SHINGLE, len(sequence))):
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sequence[k : k + len(run)]
    return np.unique(run)


def fingerprint(text: str | None) -> np.ndarray | None:
    """(BITS + SHINGLE_BITS) // 8 bytes, or None without a word; words and shingles count once, however often they occur."""
    words = WORD.findall(text.lower()) if text else None
    if not words:
        return None
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in number), np.uint64, len(number))
    sequence = hashes[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
    return np.concatenate([_signs(hashes, BITS), _signs(shingles(sequence), SHINGLE_BITS)])


def lanes_of(prints: np.ndarray) -> np.ndarray:
    """(n, LANES) integers of LANE_BITS bits from the first of (n, ...) bytes."""
    bits = np.unpackbits(prints[:, : LANES * LANE_BITS // 8], axis=1).reshape(len(prints), LANES, LANE_BITS)
    out = np.zeros((len(prints), LANES), np.int64)
    for k in range(LANE_BITS):
        out = (out << 1) | bits[:, :, k]
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print) of the rows that have an identifier and a word."""

    def run(batches):
        for batch in batches:
            ids, prints = [], []
            for i, x in enumerate(batch.column(1)):
                p = fingerprint(x.as_py())
                if p is not None:
                    ids.append(i)
                    prints.append(p.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(prints, pa.binary())], names=["id", "print"])

    kept = df.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, print binary")


def _lanes(batches):
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(rows, -1)
        tagged = lanes_of(raw) | (np.arange(LANES, dtype=np.int64) << LANE_BITS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * LANES, pa.int32()), pa.array(tagged.ravel()))], names=["rep", "lanes"])


def _met(block: int):
    """From (variant, rep) sorted by both: the sets of two and more fingerprints that share a variant; of more than
    ``block``, blocks of that many with their variant."""

    def run(batches):
        key, held, size, cut = None, [], 0, False

        def out(found, variant=None):
            found = [x for x in found if len(x) > 1 or variant is not None]
            return pa.RecordBatch.from_arrays([pa.array([variant] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["variant", "members"])

        def blocks(whole, last):
            """Full blocks of a variant that goes on; all that is left of one that ends."""
            nonlocal held, size, cut
            at = 0
            while len(whole) - at > block:
                yield out([whole[at : at + block]], key)
                at, cut = at + block, True
            rest = whole[at:]
            if last:
                yield out([rest], key if cut else None)
                held, size, cut = [], 0, False
            else:
                held, size = [rest], len(rest)

        for batch in batches:
            v, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(v):
                continue
            edge = np.concatenate([[0], np.flatnonzero(np.diff(v)) + 1, [len(v)]])
            if held and v[0] == key:
                held.append(r[: edge[1]])
                size += int(edge[1])
                if len(edge) == 2:
                    if size > block:
                        yield from blocks(np.concatenate(held), False)
                    continue
                first = 1
            else:
                first = 0
            if held:
                yield from blocks(np.concatenate(held), True)
            starts, ends = edge[first:-2], edge[first + 1 : -1]
            several = np.flatnonzero(ends - starts > 1)
            small = []
            for i in several.tolist():
                if ends[i] - starts[i] > block:
                    key = int(v[starts[i]])
                    yield from blocks(r[starts[i] : ends[i]], True)
                else:
                    small.append(r[starts[i] : ends[i]])
            yield out(small)
            key, held, size = int(v[-1]), [r[edge[-2] :]], len(v) - int(edge[-2])
        if held:
            yield from blocks(np.concatenate(held), True)

    return run


def _verify(limit: int, shingle_limit: int):
    """Verified pairs of each set, thinned to a spanning forest: the same components with one pair a member."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                ids = np.array([m["rep"] for m in members], np.int64)
                bits = np.frombuffer(b"".join(m["print"] for m in members), np.uint64).reshape(len(ids), -1)
                left = np.arange(len(ids))
                while len(left):
                    todo, left = [left[0]], left[1:]
                    while todo and len(left):
                        at = todo.pop()
                        apart = np.bitwise_count(bits[left] ^ bits[at])
                        near = (apart[:, : BITS // 64].sum(1) <= limit) & (apart[:, BITS // 64 :].sum(1) <= shingle_limit)
                        found, left = left[near], left[~near]
                        todo.extend(found)
                        a.extend([ids[at]] * len(found))
                        b.extend(ids[found])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_edges(prints: DataFrame, max_distance: int = MAX_DISTANCE, shingle_distance: int = SHINGLE_DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): edges whose components are those of all met and verified pairs of (id, print) rows."""
    reps = prints.groupBy("print").agg(F.min("id").alias("rep"))
    same = prints.join(reps, "print").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    flips = F.explode(F.array(*[F.lit(0).cast("long")], *[F.lit(1 << k).cast("long") for k in range(LANE_BITS)]))
    lanes = reps.select("rep", "print").mapInArrow(_lanes, "rep long, lanes array<long>")
    ball = lanes.select("rep", F.explode("lanes").alias("lane")).select("rep", "lane", flips.alias("flip")).select(F.col("lane").bitwiseXOR(F.col("flip")).alias("variant"), "rep")
    met = stored(ball.repartition("variant").sortWithinPartitions("variant", "rep").mapInArrow(_met(block), "variant long, members array<long>"), "met")
    # neighbours of a hot lane value share many variants, and so the same blocks: each pair of blocks once
    hot = met.where("variant is not null").withColumn("name", F.xxhash64("members"))
    names = hot.groupBy("variant").agg(F.array_sort(F.collect_set("name")).alias("names"))
    pairs = names.select(F.posexplode("names").alias("i", "x"), "names").select("x", F.explode(F.slice("names", F.col("i") + 1, F.size("names"))).alias("y")).distinct()
    blocks = hot.select("name", "members").dropDuplicates(["name"])
    both = pairs.join(blocks.toDF("x", "p"), "x").join(blocks.toDF("y", "q"), "y").select(F.array_union("p", "q").alias("members"))
    sets = met.where("variant is null").select("members").distinct().unionByName(both).select(F.xxhash64("members").alias("met"), F.explode("members").alias("rep"))
    full = sets.join(reps, "rep").groupBy("met").agg(F.collect_list(F.struct("rep", "print")).alias("members"))
    near = full.select("members").mapInArrow(_verify(max_distance, shingle_distance), "a long, b long")
    return same.unionByName(near)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, group_id) for every document with an identifier; group_id is the least identifier of its group."""
    prints = stored(fingerprints(df, id_col, text_col), "prints")
    roots = components(near_edges(prints, max_distance, block=BLOCK))
    ids = df.where(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("doc_id")).distinct()
    return ids.join(roots, ids.doc_id == roots.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``df`` whose document leads its group; rows without an identifier stay.

    Documents and dropped identifiers are shuffled at every size: the identifiers grow with the table.
    """
    (gone,) = named(df, "gone")
    prints = stored(fingerprints(df, id_col, text_col), "prints")
    roots = components(near_edges(prints, max_distance, block=BLOCK)).where("node <> root").select(F.col("node").alias(gone))
    key = col(id_col).cast("long")
    kept = df.where(key.isNotNull()).join(roots.hint("shuffle_hash"), key == F.col(gone), "left_anti")
    return kept.unionByName(df.where(key.isNull()))
