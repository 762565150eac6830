"""Row numbers and random numbers that stay with their rows; splits and chunks made of them."""

from __future__ import annotations

import random as python_random
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir

RESOLUTION = 2**31 - 1


def rand_of(row_number: Column) -> Column:
    """A hash of the row number, from 0; a linear congruential step would put all rows in one chunk of three."""
    return F.xxhash64(row_number.cast("long")).bitwiseAND(F.lit(2**63 - 1))


def with_sys(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Adds ``sys`` (id, rand), written to the shared folder so that the numbers never change.

    Ids count from 1 in the given order, by a range sort and the sizes of its partitions: no single task sees all rows.
    """
    spark = df.sparkSession
    ordered = df.drop("sys").orderBy(*order) if order else df.drop("sys")
    numbered = ordered.withColumns({"__at": F.spark_partition_id(), "__n": F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)})
    path = f"{shared_dir(spark)}/weft-sys-{uuid.uuid4().hex}"
    numbered.write.parquet(path)
    table = spark.read.schema(numbered.schema).parquet(path)
    sizes = sorted(table.groupBy("__at").count().collect())  # one row a partition
    starts, total = {}, 0
    for at, n in sizes:
        starts[at], total = total, total + n
    # one row of two numbers for each partition of the input
    offsets = F.broadcast(spark.createDataFrame(list(starts.items()), "__at int, __start long"))
    number = (F.col("__start") + F.col("__n") + 1).cast("long")
    return table.join(offsets, "__at").select(F.struct(number.alias("id"), rand_of(number).alias("rand")).alias("sys"), *[F.col(f"`{c}`") for c in ordered.columns])


def chunk(df: DataFrame, index: int, total: int) -> DataFrame:
    """Rows whose random number falls to part ``index`` of ``total``."""
    if not 0 <= index < total:
        raise ValueError("index must be from 0 to total - 1")
    return df.where(F.pmod(F.col("sys.rand"), F.lit(total)) == index)


def chunk_limit(limit: int, index: int, total: int) -> int:
    """A limit's share for a chunk."""
    return limit // total + (index < limit % total)


def split_bounds(weights: list[float]) -> list[int]:
    if len(weights) < 2 or any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("two weights and more are needed, none below 0")
    bounds, part = [0], 0.0
    for w in weights[:-1]:
        part += w / sum(weights)
        bounds.append(min(RESOLUTION, round(part * RESOLUTION)))
    return [*bounds, RESOLUTION]


def split_conditions(rand: Column, weights: list[float], seed: int | None = None) -> list[Column]:
    """A condition for each disjoint part; together they hold all rows."""
    place = rand % RESOLUTION
    if seed is not None:
        place = place * python_random.Random(seed).randrange(1, RESOLUTION) % RESOLUTION
    bounds = split_bounds(weights)
    parts = [(place >= low) & (place < high) for low, high in zip(bounds, bounds[1:])]
    return [*parts[:-1], place >= bounds[-2]]
