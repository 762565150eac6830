"""Rows of tabular files that a column names, by Arrow's dataset readers in the tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..schema import FILE, normal_names
from ..storage import filesystem
from .readers import struct_of

FORMATS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "pq": "parquet", "arrow": "ipc", "feather": "ipc"}


def format_of(path: str) -> str:
    kind = FORMATS.get(path.rpartition(".")[2].lower())
    if kind is None:
        raise ValueError(f"no table is read from {path!r}")
    return kind


def _open(source: str, path: str, format: str | None, options: dict, types: dict[str, pa.DataType] | None = None):
    """A file's table, with ``types`` for the columns that they name; None for a text file without a byte. Arrow takes the
    types of a text file from its first block."""
    from pyarrow import csv, dataset

    fs, at = filesystem(f"{source.rstrip('/')}/{path}" if source else path)
    kind = format or format_of(path)
    if kind in ("csv", "json") and fs.get_file_info(at).size == 0:
        return None
    if kind == "csv":
        parse = csv.ParseOptions(delimiter=options.get("delimiter", "\t" if path.endswith(".tsv") else ","), newlines_in_values=True)
        scan = dataset.CsvFragmentScanOptions(convert_options=csv.ConvertOptions(column_types=types))
        kind = dataset.CsvFileFormat(parse_options=parse, default_fragment_scan_options=scan)
    return dataset.dataset(at, filesystem=fs, format=kind)


def _wider(a: pa.DataType, b: pa.DataType) -> pa.DataType:
    """A type that holds the values of both: strings if there is none else, the first if either is nested."""
    a, b = (t.value_type if pa.types.is_dictionary(t) else t for t in (a, b))
    try:
        return pa.unify_schemas([pa.schema([("x", a)]), pa.schema([("x", b)])], promote_options="permissive").field(0).type
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return a if pa.types.is_nested(a) or pa.types.is_nested(b) else pa.string()


def _types(source: str, path: str, format: str | None, options: dict) -> dict[str, pa.DataType]:
    """The types of a file's columns; those of a CSV file fit all its rows."""
    from pyarrow import csv

    table = _open(source, path, format, options)
    if table is None:
        return {}
    found = dict(zip(table.schema.names, table.schema.types))
    if (format or format_of(path)) != "csv":
        return found
    try:
        for _ in table.to_batches():
            pass
        return found
    except pa.ArrowInvalid:  # a later block has other types: each block's are taken
        names, kinds = list(found), [pa.null()] * len(found)
        for part in _open(source, path, format, options, dict.fromkeys(names, pa.string())).to_batches():
            if part.num_rows:
                csv.write_csv(part, text := pa.BufferOutputStream(), csv.WriteOptions(include_header=False))
                block = text.getvalue()
                read = csv.read_csv(pa.BufferReader(block), csv.ReadOptions(column_names=names, block_size=len(block) + 1), csv.ParseOptions(newlines_in_values=True))
                kinds = [_wider(a, b) for a, b in zip(kinds, read.schema.types)]
        return dict(zip(names, kinds))


def _files(files: DataFrame, model: str) -> DataFrame:
    n = files.sparkSession.sparkContext.defaultParallelism
    return files.select(F.struct(F.col(f"{model}.source").alias("source"), F.col(f"{model}.path").alias("path")).alias("f")).repartition(n, F.rand(1))


def infer_types(files: DataFrame, model: str = "file", format: str | None = None, options: dict | None = None) -> dict[str, pa.DataType]:
    """The columns of the first file by path that has any, with types that fit all rows of all files; files are looked
    through in tasks. Column names as outside names become here."""
    options = options or {}

    def run(batches):
        for batch in batches:
            for f in batch.column(0).to_pylist():
                found = _types(f["source"], f["path"], format, options)
                new = normal_names(list(found))
                kind = pa.schema([(new[k], t) for k, t in found.items()]).serialize().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([f["source"]]), pa.array([f["path"]]), pa.array([kind], pa.binary())], names=["s", "p", "kind"])

    seen = _files(files, model).mapInArrow(run, "s string, p string, kind binary").groupBy("kind").agg(F.min(F.struct("s", "p")).alias("at")).orderBy("at").collect()
    kinds = [k for r in seen if (k := pa.ipc.read_schema(pa.py_buffer(bytes(r.kind)))).names]
    if not kinds:
        raise ValueError("there is no file to infer a schema from")
    out = dict(zip(kinds[0].names, kinds[0].types))
    for k in kinds[1:]:
        out |= {n: _wider(out[n], t) for n, t in zip(k.names, k.types) if n in out}
    return out


def infer_schema(files: DataFrame, model: str = "file", format: str | None = None, options: dict | None = None) -> T.StructType:
    """As ``infer_types``; columns without a value are strings."""
    return _schema(infer_types(files, model, format, options))


def _schema(types: dict[str, pa.DataType]) -> T.StructType:
    return from_arrow_schema(pa.schema([(n, pa.string() if pa.types.is_null(t) else t) for n, t in types.items()]))


def parse(files: DataFrame, output, column: str, model: str, source: bool, nrows: int | None, format: str | None, options: dict) -> DataFrame:
    """One task a file at least; batches stream, no file is held whole. Files in other columns' order are matched by name."""
    schema, types = struct_of(output), None
    if schema is None:
        types = infer_types(files, model, format, options)
        schema = _schema(types)
    wanted = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for f in batch.column(0).to_pylist():
                table = _open(f["source"], f["path"], format, options)
                if table is None:
                    continue
                new = normal_names(table.schema.names)
                fit = _types(f["source"], f["path"], format, options) if types is None else {n: types[k] for n, k in new.items() if k in types}
                table = _open(f["source"], f["path"], format, options, fit)
                left = nrows
                for part in table.to_batches():
                    if left is not None:
                        part = part.slice(0, left)
                        left -= part.num_rows
                    have = {new[n]: c for n, c in zip(part.schema.names, part.columns)}
                    by_place = list(part.columns) if output is not None and not set(wanted.names) & set(have) else None
                    cols = [by_place[i].cast(w.type) if by_place else have[w.name].cast(w.type) if w.name in have else pa.nulls(part.num_rows, w.type) for i, w in enumerate(wanted)]
                    origin = [pa.array([f] * part.num_rows, pa.struct([("source", pa.string()), ("path", pa.string())]))]
                    yield pa.RecordBatch.from_arrays([*cols, *origin], names=[*wanted.names, "__file"])
                    if left == 0:
                        break

    rows = _files(files, model).mapInArrow(run, T.StructType([*schema.fields, T.StructField("__file", T.StructType([f for f in FILE if f.name in ("source", "path")]))]))
    cols = [F.struct(*schema.fieldNames()).alias(column)] if column else [F.col(f"`{c}`") for c in schema.fieldNames()]
    return rows.select(*cols, *([F.col("__file").alias("source")] if source else []))
