import random

import pytest
from pyspark.sql import functions as F

from weft.llm import common
from weft.llm import exact_dedup as x

SCHEMA = "doc_id long, text string, lang string, __weft_hash int, OWNER_ID string"


def brute(rows):
    least = {}
    for r in rows:
        if r[1] is not None and r[0] is not None:
            least[r[1]] = min(least.get(r[1], r[0]), r[0])
    return sorted(((r[0], r[0] if r[1] is None else least.get(r[1])) for r in rows), key=str)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    texts = ["", "a", "ab", "abc", "abd", "é", "é" * 40_000, "x" * 300_000, "x" * 299_999 + "y", None]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    rows = [(i, rng.choice(texts), "en", 7, "z") for i in range(n)]
    return [*rows, rows[3], rows[3], (None, "abc", "en", 1, "q"), (None, "only without id", "en", 1, "q")]


@pytest.mark.parametrize("spill,chunk", [(1, 3), (20_000, 8192), (20_000, 2), (1 << 30, 5), (1 << 30, 8192)])
def test_groups_equal_brute_force_at_any_memory(spark, spill, chunk):
    rows = corpus()
    got = x.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), spill_bytes=spill, chunk=chunk).collect()
    assert sorted(((r.doc_id, r.owner_id) for r in got), key=str) == brute(rows)


def test_owners_keep_one_row_a_text_and_all_columns(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = x.drop_exact(df, spill_bytes=50_000)
    assert kept.columns == df.columns
    got = kept.collect()
    with_text = [r for r in got if r.text is not None]
    assert len(with_text) == len({r[1] for r in rows if r[1] is not None})
    assert {(r.doc_id, r.text) for r in with_text if r.doc_id is not None} <= {(r[0], r[1]) for r in rows}
    assert sum(r.text is None for r in got) == sum(r[1] is None for r in rows)


@pytest.mark.parametrize("spill", [1, 1 << 30])
def test_texts_whose_hashes_collide_stay_apart(spark, spill):
    rows = [(i, t, "en", 1, "") for i, t in enumerate(["aa", "ab", "aa", "ba", "ab", "aa"])]
    got = x.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(2), spill_bytes=spill, chunk=1, hash_expr=F.lit(5).cast("long"))
    assert sorted((r.doc_id, r.owner_id) for r in got.collect()) == [(0, 0), (1, 1), (2, 0), (3, 3), (4, 1), (5, 0)]


def test_a_hot_text_leaves_in_pieces_and_rows_without_anything_stay(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("text")).repartition(6)
    rows = x.exact_groups(df, chunk=500)
    assert rows.where("owner_id = 1").count() == 40_000 and rows.where("doc_id is null and owner_id is null").count() == 20_000
    widest = x._owner_rows(df, "doc_id", "text", x.SPILL_BYTES, True, 500).agg(F.max(F.size("ids"))).first()[0]
    assert widest <= 500 + 10_000  # the copies of a batch at most beyond the piece
    assert x.drop_exact(df).count() == 20_001


def test_identifiers_that_are_no_integers_raise(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        x.exact_groups(spark.createDataFrame([("a", "t")], "doc_id string, text string")).collect()


def test_ties_keep_the_least_remaining_columns(spark):
    rows = [(1, "t", "fr", 1, ""), (1, "t", "de", 1, ""), (2, "t", "aa", 1, "")]
    assert [r.lang for r in x.drop_exact(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()] == ["de"]


def test_addresses_of_stores():
    assert [common.arrow_root(u) for u in ("/a/b c", "s3a://b/k/%20", "hdfs://n:8020/x", "file:///t#")] == [("", "/a/b c"), ("s3://b/", "k/%20"), ("hdfs://n:8020/", "x"), ("", "/t#")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert x.exact_groups(df).collect() == [] and x.drop_exact(df).collect() == []


def test_trie_splits_edges_and_finds_strings_again():
    rng = random.Random(3)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    trie, nodes = x.Trie(), {}
    for k in keys:
        node = trie.insert(k)
        assert nodes.setdefault(k, node) is node
    for k in keys:
        assert trie.insert(k) is nodes[k]
