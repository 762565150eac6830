"""What the operators of this subpackage share: the shared folder, lineage cuts, name clashes, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only if
    all tasks run on this machine; on a cluster an unset folder raises."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="weft-shared-"))
    return _fallback[0]


def arrow_root(uri: str) -> tuple[str, str]:
    """The root of an address's store as Arrow's file systems take it, and the path below it, taken as it stands."""
    scheme, found, rest = uri.partition("://")
    if not found or scheme.lower() == "file":
        return "", rest if found else uri.removeprefix("file:")
    authority, _, path = rest.partition("/")
    store = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}.get(scheme.lower(), scheme)
    return f"{store}://{authority}/", path


def filesystem(uri: str):
    """(pyarrow filesystem, path) of an address, also of one with a scheme that only Hadoop has for the same store."""
    from pyarrow import fs

    root, path = arrow_root(uri)
    if not root:
        return fs.LocalFileSystem(), path
    store, base = fs.FileSystem.from_uri(root)
    return store, f"{base.rstrip('/')}/{path}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch path that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and survives lost executors."""
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def named(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        new = f"__weft_{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def col(name: str) -> Column:
    """A top-level column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the least node of its component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014); each round is written to the
    shared folder, and the loop ends when neither step changes an edge; if ``rounds`` don't
    suffice, it raises. Edges with a null end are ignored; a loop keeps its node. An empty edge table gives an empty
    result.
    """
    start = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    nodes_alone = start.where("u = v").select("u", "v").distinct()
    now, path = stored_at(
        start.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().unionByName(nodes_alone), "edges"
    )
    loops, e = now.where("u = v"), now.where("u <> v")
    keep = path
    mark = _mark(e)
    spark, old = edges.sparkSession, None
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node hang on the least of its neighbourhood
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's lower neighbours, and itself, hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e, path = stored_at(small, "edges")
        if old:
            drop_path(spark, old)
        old = path
        seen, mark = mark, _mark(e)
        if mark == seen:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not converge in {rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    rest = loops.select(F.col("u").alias("node"), F.col("v").alias("root"))
    del keep
    return roots.unionByName(own).unionByName(rest).groupBy("node").agg(F.min("root").alias("root"))


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]
