import duckdb
import numpy as np
import pytest

from weft.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, id string, tile int"


def corpus(n=300, d=24, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(0, n, 3):  # near copies around the threshold, and exact ones
        x[i + 1] = x[i] + rng.normal(size=d) * rng.uniform(0.2, 0.7)
    x[8], x[11] = x[5] * 3, x[5]
    x[200:240] = x[200] + rng.normal(size=(40, d)) * 0.1  # a group of near copies
    return [(i, v.tolist(), "x", 1) for i, v in enumerate(x)]


def brute(rows, threshold):
    """(id, class, links) of each row, from all pairs."""
    rows = [r for r in rows if r[0] is not None]
    units = []
    for r in rows:
        v = None if r[1] is None else np.array([np.nan if z is None else z for z in r[1]], np.float32).astype(float)
        units.append(v / np.abs(v).max() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
        if units[-1] is not None:
            units[-1] = units[-1] / np.linalg.norm(units[-1])
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(units):
        for j, y in enumerate(units):
            if i != j and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links[i] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], least[find(i)], links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile,band,cell", [(16, 1, 1), (16, 4, 8), (1000, 32, 32)])
def test_classes_and_links_equal_brute_force(spark, tile, band, cell):
    rows = corpus()
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] * 24, [inf] * 24, [None] * 24, [1.0, 2.0], [2.0, 4.0], [1e30] * 24, [1e-30] * 24, [-0.0, 1.0], [0.0, 1.0]]
    rows += [(1000 + i, v, "x", 1) for i, v in enumerate(odd)] + [(None, rows[0][1], "x", 1), rows[1], (1, rows[4][1], "x", 1)]
    got = e.near_classes(spark.createDataFrame(rows, SCHEMA).repartition(5), 0.9, tile=tile, band=band, cell=cell)
    assert got.columns == ["vec_id", "class_id", "n_links"]
    want = brute(rows, 0.9)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[2] for w in want) > 500 and len({w[1] for w in want}) > 100


@pytest.mark.parametrize("threshold", [0.3, 0.4])
def test_sql_agrees_where_the_drivers_vectors_have_links(spark, threshold):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    got = sorted(tuple(r) for r in e.near_classes(spark.read.parquet(path), threshold, tile=64).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert got == sorted(con.sql(e.classes_sql(threshold)).fetchall())
    assert sum(r[2] for r in got) > 20


def test_a_hot_vector_and_a_hot_group_give_a_row_each(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, base.tolist(), "", 0) for i in range(3000)] + [(3000 + i, (base + rng.normal(size=16) * 1e-3).tolist(), "", 0) for i in range(1500)]
    got = e.near_classes(spark.createDataFrame(rows, SCHEMA).repartition(6), tile=128).collect()
    assert len(got) == 4500 and {(r.class_id, r.n_links) for r in got} == {(0, 4499)}


def test_very_long_and_double_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 3000))
    x[1] = x[0] + rng.normal(size=3000) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in e.near_classes(df).collect()) == [(0, 0, 1), (1, 0, 1)] + [(i, i, 0) for i in range(2, 6)]


def test_bounds_hold_and_spare_most_pairs():
    rng = np.random.default_rng(1)
    x = e._unit(rng.normal(size=(400, 64)))
    codes, scales, errors = e.quantise(x)
    exact = x @ x.T
    about = (codes.astype(float) @ codes.astype(float).T) * scales[:, None] * scales[None, :]
    bound = errors[:, None] + (1 + errors)[:, None] * errors[None, :] + e.SLACK
    assert (np.abs(exact - about) <= bound).all() and bound.max() < 0.05
    p, q, sure = e.candidates((codes, scales, errors), (codes, scales, errors), 0.9)
    assert {(i, j) for i, j in zip(*np.nonzero(exact >= 0.9))} <= set(zip(p, q))
    assert (exact[p, q][sure] >= 0.9).all() and len(p) < 500


def test_forest_joins_whatever_the_order():
    rng = np.random.default_rng(3)
    for _ in range(20):
        forest, parent = e.Forest(60), list(range(60))
        for _ in range(4):
            a, b = rng.integers(0, 60, (2, 9))
            forest.join(a, b)
            for x, y in zip(a, b):
                x, y = parent[x], parent[y]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
        assert forest.root.tolist() == parent


def test_empty_table(spark):
    assert e.near_classes(spark.createDataFrame([], SCHEMA)).collect() == []
