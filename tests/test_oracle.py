"""Every query with SQL against DuckDB, as sorted rows; those without give rows at least."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weft import queries as reference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(reference.queries()))
def test_query(spark, duck, name):
    df = reference.queries()[name](spark, SF)
    sql = reference.oracle_sql().get(name)
    got = df.collect()
    assert got
    if not sql:
        return
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
