"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality, toxicity
from .chat_format import CHAT_SQL, format_chats
from .embedding_dedup import classes_sql, near_classes
from .exact_dedup import exact_groups
from .html_extract import extract
from .mixing import TARGETS, mix, mixing_sql
from .packing import pack_conversations
from .simhash_dedup import near_groups
from .warc import to_shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), TARGETS, report=True)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_conversations(_table(spark, sf_dir, "conversations"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_shared_folder(_table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


OP10 = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner_id FROM documents"


OPERATORS = [
    op1_html_extraction, op2_mixing, op3_embedding_near_dedup, op4_packing, op5_quality,
    op6_toxicity, op7_chat_format, op8_warc, op9_simhash_near_dedup, op10_exact_dedup,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """The rest are held against brute force in tests/llm."""
    return {"op2_mixing": mixing_sql(targets=TARGETS), "op3_embedding_near_dedup": classes_sql(), "op7_chat_format": CHAT_SQL, "op10_exact_dedup": OP10}
