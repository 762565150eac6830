"""Vector bin packing of training examples by the dot-product heuristic.

An example has tokens, segments and loss-bearing tokens; a pack has a limit on each. Examples are dealt to shards of
about ``shard_items`` by a hash of their identifier, and each shard is packed on its own: into the open pack goes,
of the examples that fit, the one with the largest dot product of its demand and the pack's remaining room, each
dimension as a share of its limit and weighted by the shard's mean demand (Panigrahy et al., 2011); when none fits,
the next pack opens. Ties go to the smaller identifier, then part.

An example beyond a limit is cut into consecutive parts. Of a conversation each part is a run of whole turns, as many
as the limits allow, and a turn that is beyond a limit by itself is cut into the fewest even parts of its own; so a
part carries the loss-bearing tokens that stand in it. Turns go by (turn, role, text), nulls first. Other examples,
of which only counts are known, are cut into the fewest parts of even size, each with an even share of every count.
Nothing is truncated: the parts' tokens and loss-bearing tokens add up to the example's. A part is a segment of its
pack and counts as at least one.

Defined results: null tokens and loss-bearing tokens are 0; null identifiers are packed like others, spread over
all shards; repeated rows are
examples of their own; an example without tokens or segments still takes one segment; an empty table gives no packs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stored
from .mixing import tokens_of

SHARD_ITEMS = 4000
PACKS = "pack_id long, doc_ids array<long>, parts array<int>, part_tokens array<long>, tokens long, segments long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """What a pack holds at most."""

    tokens: int = 4096
    segments: int = 16
    loss_tokens: int = 3072

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.int64)


def dot_product_packs(demand: np.ndarray, limit: np.ndarray) -> list[list[int]]:
    """Rows of ``demand`` (n, 3), each within ``limit``, as lists of row numbers by pack."""
    mean = demand.mean(0) / limit if len(demand) else np.zeros(3)
    at, left = np.arange(len(demand)), demand.copy()
    share = left / limit * mean
    free = np.ones(len(at), bool)
    packs: list[list[int]] = []
    room, n = None, len(at)
    while n:
        if room is None:
            packs.append([])
            room = limit.copy()
        fits = free & (left[:, 0] <= room[0]) & (left[:, 1] <= room[1]) & (left[:, 2] <= room[2])
        score = np.where(fits, share @ (room / limit), -1.0)
        best = int(score.argmax())
        if score[best] < 0:
            room = None
            continue
        packs[-1].append(int(at[best]))
        room = room - left[best]
        free[best] = False
        n -= 1
        if n * 2 < len(at):  # so that later steps look at what is left only
            at, left, share, free = at[free], left[free], share[free], free[free]
    return packs


def parts_of(items: DataFrame, limits: Limits) -> DataFrame:
    """(id, tokens, segments, loss) cut into (id, part, tokens, segments, loss), each within the limits."""
    need = F.greatest(F.ceil(F.col("tokens") / limits.tokens), F.ceil(F.col("segments") / limits.segments), F.ceil(F.col("loss") / limits.loss_tokens), F.lit(1).cast("long"))

    def cut(c: str) -> Column:
        return (F.floor((F.col("part") + 1) * F.col(c) / F.col("n")) - F.floor(F.col("part") * F.col(c) / F.col("n"))).alias(c)

    return items.withColumn("n", need).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("id", F.col("part").cast("int").alias("part"), cut("tokens"), F.greatest(cut("segments"), F.lit(1).cast("long")).alias("segments"), cut("loss"))


def turn_parts(tokens: list[int], trained: list[bool], limits: Limits) -> list[tuple[int, int]]:
    """(tokens, loss-bearing tokens) of the consecutive parts of a conversation, from those of its turns in order."""
    parts, t, x = [], 0, 0
    for n, bears in zip(tokens, trained):
        loss = n if bears else 0
        if t and (t + n > limits.tokens or x + loss > limits.loss_tokens):
            parts.append((t, x))
            t, x = 0, 0
        pieces = max(1, -(-n // limits.tokens), -(-loss // limits.loss_tokens))
        for k in range(pieces - 1):
            size = (k + 1) * n // pieces - k * n // pieces
            parts.append((size, size if bears else 0))
        last = n - (pieces - 1) * n // pieces
        t, x = t + last, x + (last if bears else 0)
    return [*parts, (t, x)] if t or not parts else parts


def pack(df: DataFrame, limits: Limits, identifier: Column, tokens: Column, segments: Column, loss: Column, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row a pack: its parts of examples in the order placed, and the sums that the limits hold for."""
    clean = lambda c: F.greatest(F.coalesce(c.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    items = df.select(identifier.cast("long").alias("id"), clean(tokens).alias("tokens"), clean(segments).alias("segments"), clean(loss).alias("loss"))
    return pack_parts(parts_of(items, limits), limits, shard_items)


def pack_parts(parts: DataFrame, limits: Limits, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The packs of (id, part, tokens, segments, loss), each part within the limits."""
    # rows without an identifier are told apart by a number of their own, or all would fall into one shard
    parts = stored(parts.withColumn("own", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), "examples")
    shards = max(1, -(-parts.count() // shard_items))
    dealt = parts.withColumn("shard", F.when(F.col("own").isNull(), F.pmod(F.xxhash64("id", "part"), F.lit(shards))).otherwise(F.pmod(F.xxhash64("own"), F.lit(shards)))).drop("own")
    limit = limits.array()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part", "tokens", "segments", "loss"], na_position="first", kind="stable").reset_index(drop=True)
        demand = pdf[["tokens", "segments", "loss"]].to_numpy(np.int64)
        ids = [None if pd.isna(x) else int(x) for x in pdf["id"]]
        rows = []
        for k, rows_of in enumerate(dot_product_packs(demand, limit)):
            t, s, x = demand[rows_of].sum(0).tolist()
            rows.append((int(key[0]) << 32 | k, [ids[i] for i in rows_of], pdf["part"].to_numpy()[rows_of].tolist(), demand[rows_of, 0].tolist(), t, s, x))
        return pd.DataFrame(rows, columns=["pack_id", "doc_ids", "parts", "part_tokens", "tokens", "segments", "loss_tokens"])

    return dealt.groupBy("shard").applyInPandas(one, PACKS)


def pack_conversations(df: DataFrame, limits: Limits = Limits(), trained: str = "assistant", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Packs of whole conversations: a segment each, their loss-bearing tokens those of the trained role's turns.

    Turns without a conversation's identifier are left out.
    """
    words = tokens_of(col("text"))
    bears = F.coalesce(col("role") == trained, F.lit(False))
    turns = df.where(col("conv_id").isNotNull()).select(col("conv_id").alias("id"), col("turn").alias("turn"), F.coalesce(col("role"), F.lit("unknown")).alias("role"), F.coalesce(col("text"), F.lit("")).alias("text"), words.alias("tokens"), bears.alias("bears"))
    by = stored(turns.groupBy("id").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("bears"), F.col("tokens")).otherwise(0)).alias("loss")), "conversations")
    beyond = (F.col("tokens") > limits.tokens) | (F.col("loss") > limits.loss_tokens)
    whole = by.where(~beyond).select(F.col("id").cast("long").alias("id"), F.lit(0).alias("part"), "tokens", F.lit(1).cast("long").alias("segments"), "loss")
    said = F.struct("turn", "role", "text", "tokens", "bears")
    # texts are shuffled only of the conversations to cut, for the order of their turns
    long = turns.join(by.where(beyond).select("id"), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list(said)).alias("turns"))
    long = long.select(F.col("id").cast("long").alias("id"), F.col("turns.tokens").alias("tokens"), F.col("turns.bears").alias("bears"))

    def cut(batches):
        for batch in batches:
            rows = [(i, k, t, 1, x) for i, tokens, bear in zip(*(c.to_pylist() for c in batch.columns)) for k, (t, x) in enumerate(turn_parts(tokens, bear, limits))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "part", "tokens", "segments", "loss"])

    parts = whole.unionByName(long.mapInArrow(cut, "id long, part int, tokens long, segments long, loss long"))
    return pack_parts(parts, limits, shard_items)


def pack_documents(df: DataFrame, limits: Limits = Limits(8192, 32, 8192), shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Packs of documents: a segment each, all their tokens bearing loss."""
    slim = df.select(col("doc_id").alias("id"), tokens_of(col("text")).alias("tokens"))
    return pack(slim, limits, F.col("id"), F.col("tokens"), F.lit(1), F.col("tokens"), shard_items)
