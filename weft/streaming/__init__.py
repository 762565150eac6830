"""Incremental runs as streams: beyond what the batch engine offers, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_folder(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Parquet files as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by key and event-time window; those later than the watermark don't count."""
    by = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``each(batch, batch_id)`` on all that is new, then stops; a restart goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
