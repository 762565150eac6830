import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import packing as p


def brute(demand, limit):
    """The heuristic with a loop over all that is left at each step."""
    n = len(demand)
    mean = [sum(d[k] for d in demand) / n / limit[k] for k in range(3)]
    left, packs = list(range(n)), []
    room = None
    while left:
        if room is None:
            packs.append([])
            room = list(limit)
        best, score = None, -1.0
        for i in left:
            if all(demand[i][k] <= room[k] for k in range(3)):
                s = sum(demand[i][k] / limit[k] * mean[k] * (room[k] / limit[k]) for k in range(3))
                if s > score + 1e-12:
                    best, score = i, s
        if best is None:
            room = None
            continue
        packs[-1].append(best)
        left.remove(best)
        room = [r - d for r, d in zip(room, demand[best])]
    return packs


@pytest.mark.parametrize("seed", range(4))
def test_heuristic_equals_brute_force(seed):
    rng = random.Random(seed)
    demand = [(t := rng.randint(0, 60), rng.randint(0, 3), rng.randint(0, t)) for _ in range(120)]
    limit = (100, 5, 70)
    got = p.dot_product_packs(np.array(demand, np.int64), np.array(limit, np.int64))
    assert got == brute(demand, limit)
    lower = max(-(-sum(d[k] for d in demand) // limit[k]) for k in range(3))
    assert len(got) <= 1.3 * lower + 1


def check(packs, items, limits):
    seen = {}
    for r in packs:
        assert r.tokens <= limits.tokens and r.segments <= limits.segments and r.loss_tokens <= limits.loss_tokens
        assert sum(r.part_tokens) == r.tokens and len(r.doc_ids) == len(r.parts) == len(r.part_tokens)
        for i, k, t in zip(r.doc_ids, r.parts, r.part_tokens):
            seen.setdefault(i, {})[k] = t
    assert {i: sum(x.values()) for i, x in seen.items()} == items
    assert all(sorted(x) == list(range(len(x))) for x in seen.values())
    assert len({r.pack_id for r in packs}) == len(packs)


def test_every_part_of_every_document_is_packed_once(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 400, 2500])), "x") for i in range(300)]
    rows += [(300, None, "x"), (301, "", "x"), (302, "long " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(3)
    limits = p.Limits(1000, 8, 900)
    packs = p.pack_documents(df, limits, shard_items=200).collect()
    check(packs, {i: len((t or "").split()) for i, t, _ in rows}, limits)
    assert sorted(map(tuple, packs)) == sorted(map(tuple, p.pack_documents(df.repartition(5), limits, shard_items=200).collect()))


def test_conversations_count_loss_by_role(spark):
    rows = [(1, 0, "user", "a b c"), (1, 1, "assistant", "d e"), (2, 0, "user", "f"), (3, 0, "assistant", None), (4, None, None, "g h"), (None, 0, "user", "lost"), (5, 0, "assistant", "x " * 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    limits = p.Limits(20, 3, 10)
    packs = p.pack_conversations(df, limits).collect()
    check(packs, {1: 5, 2: 1, 3: 0, 4: 2, 5: 50}, limits)
    assert sum(r.loss_tokens for r in packs) == 52


def test_repeated_rows_null_counts_and_empty_table(spark):
    df = spark.createDataFrame([(7, 3, None), (7, 3, 1), (None, None, None)], "doc_id long, t long, s long")
    packs = p.pack(df, p.Limits(4, 4, 4), F.col("doc_id"), F.col("t"), F.col("s"), F.lit(0)).collect()
    assert sorted((i or 0 for r in packs for i in r.doc_ids)) == [0, 7, 7]
    assert p.pack_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_parts_of_a_conversation_carry_the_loss_they_hold(spark):
    rows = [(1, 1, "assistant", "a " * 40), (1, 0, "user", "u " * 40), (2, 0, "user", "u " * 25), (2, 1, "assistant", "a " * 10), (2, 2, "user", "u " * 10), (3, 0, "assistant", "a " * 70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = p.pack_conversations(df, p.Limits(40, 1, 30)).collect()
    got = sorted((r.doc_ids[0], r.parts[0], r.tokens, r.loss_tokens) for r in packs)
    assert got == [(1, 0, 40, 0), (1, 1, 20, 20), (1, 2, 20, 20), (2, 0, 35, 10), (2, 1, 10, 0), (3, 0, 23, 23), (3, 1, 23, 23), (3, 2, 24, 24)]


def test_turns_are_cut_within_the_limits():
    rng = random.Random(4)
    for _ in range(300):
        limits = p.Limits(rng.randint(1, 20), 1, rng.randint(1, 20))
        tokens = [rng.choice([0, 1, 3, 10, 50]) for _ in range(rng.randint(1, 8))]
        bears = [rng.random() < 0.5 for _ in tokens]
        flat = [b for n, b in zip(tokens, bears) for _ in range(n)]
        at = 0
        for t, x in p.turn_parts(tokens, bears, limits):
            assert t <= limits.tokens and x <= limits.loss_tokens and x == sum(flat[at : at + t])
            at += t
        assert at == sum(tokens)


def test_every_part_counts_as_a_segment(spark):
    df = spark.createDataFrame([(1, "w " * 95)], "doc_id long, text string")
    packs = p.pack_documents(df, p.Limits(10, 1, 10)).collect()
    assert all(r.segments == len(r.doc_ids) == 1 for r in packs) and sum(r.tokens for r in packs) == 95
    few = spark.createDataFrame([(i, "w " * 21) for i in range(6)], "doc_id long, text string")
    assert all(r.segments == len(r.doc_ids) <= 2 for r in p.pack_documents(few, p.Limits(20, 2, 8)).collect())


def test_rows_without_an_identifier_are_spread_over_the_shards(spark):
    df = spark.createDataFrame([(None, "a b c")] * 400, "doc_id long, text string").repartition(4)
    packs = p.pack_documents(df, shard_items=50).collect()
    assert sum(len(x.doc_ids) for x in packs) == 400 and len({x.pack_id >> 32 for x in packs}) > 4
