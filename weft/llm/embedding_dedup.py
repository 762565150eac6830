"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Equal vectors are folded first. The distinct ones are normalised, dealt to cells by their nearest pivot, cut into
tiles of about ``tile`` vectors, and coded in int8 with a scale each. A vector's error is the measured norm of what
its code loses, so for codes a', b' of unit vectors a, b: |a.b - a'.b'| <= err(a) + (1 + err(a)) err(b). A pair of
tiles is multiplied in codes only (as exact integers by BLAS): pairs whose code product is above the threshold by more
than their bound are links, those below it by more are none, and only the rest are recomputed from the full vectors in
double precision. The result is exact: every vector is a query, with no cap on its partners.

Pairs of cells that can't hold a link, by the angle of their pivots and the widest angle within each, are never sent.
The pivots grow with the table. Bands of tiles of a cell meet band by band; what a pair of bands returns is for each
of its vectors the number of links and one edge of a spanning forest, so a group of a million near copies gives rows in
proportion to its members, not to its pairs. Vectors that no angle parts are all multiplied: on data without clusters
the work grows with the square of the table.

Defined results: a row for each row with an identifier: ``n_links`` other rows have a cosine of at least the threshold
with it, ``class_id`` is the least identifier that a chain of such links reaches. Vectors that are null, empty, zero, or
hold a null or non-finite number have no links and are a class of their own, as do vectors of another length to each
other; repeated rows link to each other; rows that share an identifier have a row each; rows without an identifier are
left out; an empty table gives no rows. Identifiers are integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, components, stored

THRESHOLD, TILE, BAND, CELL = 0.9, 2048, 32, 32
#: For rounding in the bounds themselves.
SLACK = 1e-6
#: Pivots fit a broadcast of 64 MB; fewer than the table would ask for only make cells larger.
PIVOT_BYTES = 64 << 20
TILES = "band long, dim int, n int, keys binary, copies binary, raw binary, codes binary, scales binary, errors binary"


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of unit vectors (n, d)."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def candidates(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the pairs of two tiles that may reach the threshold, and whether they surely do; a tile is
    (codes, scales, errors)."""
    # up to 2**24 / 127**2 = 1040 products a float32 sum is an exact integer
    kind = np.float32 if a[0].shape[1] <= 1040 else np.float64
    dots = a[0].astype(kind) @ b[0].astype(kind).T
    widest = a[2].max() + (1 + a[2].max()) * b[2].max() + 2 * SLACK
    dots *= a[1].astype(kind)[:, None]
    # one comparison screens by the tiles' widest bound, what it leaves is held to its own
    p, q = np.nonzero(dots >= ((threshold - widest) / b[1]).astype(kind)[None, :])
    about = (a[0][p].astype(np.int32) * b[0][q]).sum(1) * a[1][p] * b[1][q] if len(p) < 4096 else dots[p, q] * b[1][q]
    bound = a[2][p] + (1 + a[2][p]) * b[2][q] + SLACK
    may = about + bound >= threshold
    return p[may], q[may], (about - bound >= threshold)[may]


def _clean(df: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(id, v) of the rows with a direction, and (id) of those without; -0.0 becomes 0.0."""
    kind = "float" if "float" in dict(df.dtypes)[embedding] else "double"
    v = F.transform(col(embedding), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.where(col(vec_id).isNotNull()).select(col(vec_id).cast("long").alias("id"), v.alias("v"))
    good = F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    return rows.where(good), rows.where(~good).select("id")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _assign(pivots: dict[int, np.ndarray]):
    """(key, copies, v) with the vector's length, its cell - the nearest pivot of its length - and the angle to it."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)])
            cells, angles = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                near = _unit(_matrix(batch.column(2).take(pa.array(at)))) @ pivots[int(d)].T
                cells[at] = near.argmax(1)
                angles[at] = _angles(near.max(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cells), pa.array(angles)], names=["key", "copies", "v", "dim", "cell", "angle"])

    return run


def _tile(table: pa.Table) -> pa.Table:
    raw = _matrix(table.column("v"))
    codes, scales, errors = quantise(_unit(raw))
    row = {c: table.column(c)[0].as_py() for c in ("band", "dim")} | {"n": len(raw), "raw": raw.tobytes()}
    row |= {"keys": table.column("key").to_numpy().tobytes(), "copies": table.column("copies").to_numpy().tobytes()}
    row |= {"codes": codes.tobytes(), "scales": scales.tobytes(), "errors": errors.tobytes()}
    kinds = [("band", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("keys", "copies", "raw", "codes", "scales", "errors"))]
    return pa.Table.from_pylist([row], pa.schema(kinds))


class Forest:
    """Components of 0..n-1 under unions of arrays of pairs; a root is the least of its component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def _products(threshold: float, element: str):
    """Of a pair of bands, (key, root, links) of every vector with a link: its root in the pair, its number of links."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        tiles, n = [], 0
        for r in table.to_pylist():
            codes = np.frombuffer(r["codes"], np.int8).reshape(r["n"], -1)
            unit = None
            tiles.append([(codes, np.frombuffer(r["scales"]), np.frombuffer(r["errors"])), np.frombuffer(r["raw"], element).reshape(r["n"], -1), unit, n, r["band"], r["keys"], r["copies"]])
            n += r["n"]
        keys = np.concatenate([np.frombuffer(t[5], np.int64) for t in tiles])
        copies = np.concatenate([np.frombuffer(t[6], np.int64) for t in tiles])
        links, forest = np.zeros(n, np.int64), Forest(n)

        def units(t):
            if t[2] is None:
                t[2] = _unit(t[1])
            return t[2]

        for i, x in enumerate(tiles):
            for j, y in enumerate(tiles):
                if x[4] != low or y[4] != high or low == high and j < i:
                    continue
                p, q, sure = candidates(x[0], y[0], threshold)
                keep = sure.copy()
                for part in np.array_split(np.flatnonzero(~sure), 1 + (~sure).sum() // 100_000):
                    if len(part):
                        keep[part] = np.einsum("ij,ij->i", units(x)[p[part]], units(y)[q[part]]) >= threshold
                if i == j:
                    keep &= p != q
                a, b = p[keep] + x[3], q[keep] + y[3]
                links += np.bincount(a, copies[b], n).astype(np.int64)
                if i != j:
                    links += np.bincount(b, copies[a], n).astype(np.int64)
                forest.join(a, b)
        at = np.flatnonzero(links)
        return pa.table({"key": keys[at], "root": keys[forest.root[at]], "links": links[at]})

    return run


def _pairs_of(cells: dict[int, list[tuple]], pivots: dict[int, np.ndarray], reach: float):
    """From (dim, cell) the pairs of bands to multiply: those of cells that may hold a pair within ``reach``."""

    def run(batches):
        for batch in batches:
            low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d, k in zip(*(c.to_pylist() for c in batch.columns)):
                numbers = np.array([c[0] for c in cells[d]])
                radius, first, count = (np.array([c[i] for c in cells[d]]) for i in (1, 2, 3))
                own = int(np.flatnonzero(numbers == k)[0])
                apart = _angles(pivots[d][numbers] @ pivots[d][k]) - radius - radius[own]
                mine = np.arange(first[own], first[own] + count[own])
                for other in np.flatnonzero((apart <= reach) & (np.arange(len(numbers)) >= own)):
                    a, b = np.meshgrid(mine, np.arange(first[other], first[other] + count[other]), indexing="ij")
                    fits = a <= b
                    low.append(a[fits])
                    high.append(b[fits])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], names=["low", "high"])

    return run


def linked(reps: DataFrame, threshold: float, element: str, tile: int = TILE, band: int = BAND, cell: int = CELL) -> DataFrame:
    """(key, root, links) of (key, copies, v) rows: for each pair of bands that a vector has links in, how many."""
    spark = reps.sparkSession
    counts = {r.dim: r.n for r in reps.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    pivots: dict[int, np.ndarray] = {}
    for d, n in sorted(counts.items()):
        # cells of a few tiles on a small table, for parallel work; of ``cell`` tiles on a large one
        k = max(1, min(PIVOT_BYTES // (8 * d), max(min(8, n // tile), n // (cell * tile))))
        few = reps.where(F.size("v") == d).orderBy(F.xxhash64("v"), "key").limit(k).collect()
        pivots[d] = _unit(np.array([r.v for r in few]))
    placed = reps.select("key", "copies", "v").mapInArrow(_assign(pivots), f"key long, copies long, v array<{element}>, dim int, cell long, angle double")
    rows, cells, tiles_of, bands = [], {}, [], 0
    for r in sorted(placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect(), key=lambda r: (r.dim, r.cell)):
        cuts = -(-r.n // tile)
        n_bands = -(-cuts // band)
        cells.setdefault(r.dim, []).append((r.cell, r.radius + 1e-6, bands, n_bands))
        rows.append((r.dim, r.cell))
        tiles_of.append((r.dim, r.cell, cuts, bands))
        bands += n_bands
    if not rows:
        return spark.createDataFrame([], "key long, root long, links long")
    # as many rows as there are pivots
    starts = F.broadcast(spark.createDataFrame(tiles_of, "dim int, cell long, cuts long, first long"))
    numbered = placed.join(starts, ["dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("cuts"))).withColumn("band", F.col("first") + F.floor(F.col("tile") / band))
    tiles = stored(numbered.select("band", "tile", "dim", "key", "copies", "v").groupBy("band", "tile").applyInArrow(_tile, TILES), "tiles")
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    seeds = spark.createDataFrame(rows, "dim int, cell long").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    pairs = seeds.mapInArrow(_pairs_of(cells, pivots, reach), "low long, high long")
    sides = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("band"))
    return tiles.join(sides, "band").groupBy("low", "high").applyInArrow(_products(threshold, {"float": "f4", "double": "f8"}[element]), "key long, root long, links long")


def near_classes(df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE, band: int = BAND, cell: int = CELL) -> DataFrame:
    """(vec_id, class_id, n_links) of every row with an identifier."""
    rows, lone = _clean(df, vec_id, embedding)
    element = dict(rows.dtypes)["v"][6:-1]
    # 128 bits name a vector where its members meet it again
    named = rows.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    folded = named.groupBy("h", "g", "v").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    reps = stored(folded.withColumn("key", F.monotonically_increasing_id()), "vectors")
    met = stored(linked(reps, threshold, element, tile, band, cell), "links")
    links = met.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(met.where("key <> root"), "key", "root").select(F.col("node").alias("key"), "root")
    least = roots.join(reps.select("key", "least"), "key").groupBy("root").agg(F.min("least").alias("class_id"))
    classes = roots.join(least, "root").select("key", "class_id")
    known = reps.select("key", "h", "g", "copies", "least").join(links, "key", "left").join(classes, "key", "left")
    known = known.select("h", "g", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = named.select("id", "h", "g").join(known, ["h", "g"]).select(F.col("id").alias("vec_id"), "class_id", "n_links")
    return out.unionByName(lone.select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def classes_sql(threshold: float = THRESHOLD) -> str:
    """The same over the table embeddings, in DuckDB's SQL, all pairs compared."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS e, len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
 FROM embeddings WHERE vec_id IS NOT NULL),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e) AND coalesce(a.good, false) AND coalesce(b.good, false)
 WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
r AS (SELECT k AS a, k AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS k, min(vec_id) AS class_id FROM r JOIN v ON r.b = v.k GROUP BY r.a)
SELECT v.vec_id, c.class_id, (SELECT count(*) FROM l WHERE l.a = v.k) AS n_links FROM v JOIN c USING (k)
"""
