"""The subpackage's queries against DuckDB where SQL expresses them, and the pipeline stage by stage."""

import math
import random

import duckdb
import pytest

import corpus_pipeline
from weft.llm import queries

SF = "/root/testdata/sf0.01"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    df = queries.queries()[name](spark, SF).select(*names)
    got, want = (sorted((tuple(map(plain, r)) for r in rows), key=repr) for rows in (df.collect(), res.fetchall()))
    assert got == want and got


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]


def tables(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    marked = [(r[0], 1, int("scum" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus():
    text = lambda i: ". ".join(" ".join(f"word{random.Random(1000 * i + j).randrange(4000)}" for j in range(k, k + 12)) for k in range(0, 60, 12))
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(160)]
    rows += [(200 + i, text(i) + f". you scum loser number{i}", "en", "s1", 1) for i in range(80, 140)]
    rows += [(400 + i, text(i), "en", "s2", 1) for i in range(20)]  # exact copies
    rows += [(500 + i, text(i) + " extra", "en", "s2", 1) for i in range(20)]  # near copies
    return rows + [(None, None, None, None, None), (None, "no identifier here", "en", None, 1), (600, None, "en", "s0", None), (601, "", None, "s0", 0), (601, "", None, "s0", 0), (602, "long " * 30_000, "en", "s0", 1)]


def test_each_stage_on_all_that_the_last_kept(spark, tmp_path):
    rows = corpus()
    sf = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.exceptAll(before).isEmpty()
    ids = {k: {r.doc_id for r in v} for k, v in kept.items() if k != "packing"}
    toxic = {r[0] for r in rows if "scum" in (r[1] or "")}
    assert not toxic & ids["toxicity"] and {r[0] for r in rows} - toxic == ids["toxicity"]
    texts = [r.text for r in kept["exact_dedup"] if r.text is not None]
    assert len(texts) == len(set(texts)) and {r.text for r in kept["toxicity"]} == {r.text for r in kept["exact_dedup"]}
    assert not ids["exact_dedup"] & set(range(400, 420)) and ids["simhash_near_dedup"] >= set(range(160))
    assert not ids["simhash_near_dedup"] & set(range(500, 520))
    placed = sorted(((str(d), t) for r in kept["packing"] for d, t in zip(r.doc_ids, r.part_tokens)))
    sums = {}
    for d, t in placed:
        sums[d] = sums.get(d, 0) + t
    want = {}
    for r in kept["mixing"]:
        want[str(r.doc_id)] = want.get(str(r.doc_id), 0) + len((r.text or "").split())
    assert sums == want and all(r.tokens <= 8192 and r.segments <= 32 for r in kept["packing"])
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, kept["packing"]))


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf).collect() == []
