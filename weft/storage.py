"""Folders that every executor reaches, and files in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
#: Schemes that Hadoop and Arrow name differently.
_ARROW = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder, but only if all tasks run on this
    machine; on a cluster an unset folder raises."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="weft-"))
    return _fallback[0]


def arrow_root(uri: str) -> tuple[str, str]:
    """The root of an address's store as Arrow's file systems take it, and the path below it, taken as it stands."""
    scheme, found, rest = uri.partition("://")
    if not found or scheme.lower() == "file":
        return "", rest if found else uri.removeprefix("file:")
    authority, _, path = rest.partition("/")
    return f"{_ARROW.get(scheme.lower(), scheme)}://{authority}/", path


def filesystem(uri: str):
    """(pyarrow filesystem, path) of an address, also of one with a scheme that only Hadoop has for the same store."""
    from pyarrow import fs

    root, path = arrow_root(uri)
    if not root:
        return fs.LocalFileSystem(), path
    store, base = fs.FileSystem.from_uri(root)
    return store, f"{base.rstrip('/')}/{path}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage ends there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
