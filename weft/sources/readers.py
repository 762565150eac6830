"""Tables from files, values, records and databases; all return DataFrames."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FILE, normal_names, plain, spark_type, type_of_values, without_nan
from ..sinks import renested

#: Strings that stand for null in CSV files.
NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def struct_of(output) -> T.StructType | None:
    """A schema from a dict of hints, a model or a StructType."""
    if output is None or isinstance(output, T.StructType):
        return output
    if isinstance(output, dict):
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in output.items()])
    kind = spark_type(output)
    return kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("value", kind)])


def _shaped(df: DataFrame, output, column: str, source: bool, nrows: int | None, normalise: bool = True) -> DataFrame:
    origin = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("source")] if source else []
    names = [f.name for f in df.schema]
    schema = struct_of(output)
    if schema is not None:
        cols = [F.col(f"`{o}`").cast(f.dataType).alias(f.name) for o, f in zip(names, schema)]
    else:
        new = normal_names(names) if normalise else {n: n for n in names}
        cols = [F.col(f"`{o}`").alias(n) for o, n in new.items()]
    df = df.select(*cols, *origin)
    if nrows is not None:
        df = df.limit(nrows)
    df = without_nan(df)
    return df if not column else df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "source" or not source]).alias(column), *(["source"] if source else []))


def read_csv(spark: SparkSession, path: str | list[str], delimiter: str = ",", header: bool = True, output=None, column: str = "", source: bool = False, nrows: int | None = None, column_types: dict | None = None) -> DataFrame:
    """Types are inferred unless ``output`` or ``column_types`` gives them; the usual NA strings are null."""
    if not header and output is None:
        raise ValueError("without a header the columns must be given by output")
    raw = spark.read.csv(path, sep=delimiter, header=header, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    texts = raw.select(*[F.when(~F.col(f"`{c}`").isin(NA), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if output is None:
        guess = spark.read.csv(path, sep=delimiter, header=header, escape='"', multiLine=True, inferSchema=True, nullValue="NA", samplingRatio=1.0).schema
        kinds = {f.name: T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType for f in guess}
        kinds |= {k: spark_type(v) for k, v in (column_types or {}).items()}
        texts = texts.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in texts.columns])
    return _shaped(texts, output, column, source, nrows)


def read_parquet(spark: SparkSession, path: str | list[str], partitioning: str | None = "hive", output=None, column: str = "", source: bool = False) -> DataFrame:
    """Dotted columns become structs again; folders named k=v are columns."""
    paths = [path] if isinstance(path, str) else path
    reader = spark.read if partitioning else spark.read.option("recursiveFileLookup", "true")
    df = reader.option("mergeSchema", "true").parquet(*paths) if len(paths) > 1 else reader.parquet(*paths)
    if any("." in c for c in df.columns):
        df = renested(df)
    return _shaped(df, output, column, source, None, normalise=False)


def read_json(spark: SparkSession, path: str | list[str], format: str = "json", output=None, jmespath: str | None = None, column: str = "", nrows: int | None = None) -> DataFrame:
    """JSON arrays or objects (``json``) or lines (``jsonl``); ``jmespath`` is a dotted path to a list or an object.

    Rows that don't parse are left out.
    """
    reader = spark.read.option("mode", "DROPMALFORMED").option("multiLine", format == "json")
    schema = struct_of(output)
    if schema is not None and not jmespath:
        reader = reader.schema(schema)
    df = reader.json(path)
    if jmespath:
        kind: T.DataType = df.schema
        for part in jmespath.split("."):
            kind = kind[part].dataType
        at = F.col(jmespath)
        df = df.select(F.explode(at).alias("x") if isinstance(kind, T.ArrayType) else at.alias("x"))
        df = df.select("x.*") if isinstance(df.schema["x"].dataType, T.StructType) else df.select(F.col("x").alias("value"))
    return _shaped(df, output if jmespath else None, column, False, nrows, normalise=output is None)


def read_values(spark: SparkSession, output=None, column: str = "", **values: Sequence) -> DataFrame:
    """Equal-length lists as columns; a type is that of the first value that isn't None."""
    if len({len(v) for v in values.values()}) > 1:
        raise ValueError("the lists have different lengths")
    given = struct_of(output)
    kinds = {k: given[k].dataType if given is not None and k in given.fieldNames() else type_of_values(v) for k, v in values.items()}
    schema = T.StructType([T.StructField(k, t) for k, t in kinds.items()])
    fit = lambda v, t: float(v) if isinstance(t, T.DoubleType) and isinstance(v, int) else v
    rows = [tuple(fit(plain(x), t) for x, t in zip(r, kinds.values())) for r in zip(*values.values())]
    df = spark.createDataFrame(rows, schema)
    return df if not column else df.select(F.struct("*").alias(column))


def read_records(spark: SparkSession, rows: dict | Iterable[dict], schema: dict | None = None) -> DataFrame:
    """Dicts as rows; without a schema, rows of files."""
    kind = struct_of(schema) if schema else FILE
    rows = [rows] if isinstance(rows, dict) else rows
    return spark.createDataFrame([tuple(plain(r.get(f.name)) for f in kind) for r in rows], kind)


def read_pandas(spark: SparkSession, pdf, column: str = "") -> DataFrame:
    """Column names lower-cased, levels joined by an underscore."""
    pdf = pdf.copy()
    flat = ["_".join(str(x) for x in c if x != "") if isinstance(c, tuple) else str(c) for c in pdf.columns]
    pdf.columns = list(normal_names(flat).values())
    df = without_nan(spark.createDataFrame(pdf))
    return df if not column else df.select(F.struct("*").alias(column))


def read_database(spark: SparkSession, query: str, connection: str | sqlite3.Connection, params: Sequence | dict = (), output=None, infer_schema_length: int = 100) -> DataFrame:
    """Rows of a query on SQLite; types from the first rows. Other databases take ``spark.read.jdbc``."""
    own = not isinstance(connection, sqlite3.Connection)
    db = sqlite3.connect(connection.removeprefix("sqlite:///")) if own else connection
    try:
        cur = db.execute(query, params)
        names = [d[0] for d in cur.description]
        head = list(islice(cur, infer_schema_length))
        given = struct_of(output)
        kinds = [given[n].dataType if given is not None and n in given.fieldNames() else type_of_values([r[i] for r in head]) for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, k) for n, k in zip(normal_names(names).values(), kinds)])
        fit = lambda v, t: None if v is None else float(v) if isinstance(t, T.DoubleType) else bool(v) if isinstance(t, T.BooleanType) else v
        return spark.createDataFrame([tuple(fit(v, t) for v, t in zip(r, kinds)) for r in (*head, *cur)], schema)
    finally:
        if own:
            db.close()


def read_hf(spark: SparkSession, splits: dict[str, str] | str, limit: int | None = None) -> DataFrame:
    """Parquet exports of a hub dataset, by split; several splits are told apart by a column."""
    if isinstance(splits, str):
        splits = {"train": splits}
    parts = [spark.read.parquet(p).withColumn("split", F.lit(s)) if len(splits) > 1 else spark.read.parquet(p) for s, p in splits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out if limit is None else out.limit(limit)
