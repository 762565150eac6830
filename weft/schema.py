"""Spark types from Python type hints, dataclasses and pydantic models; objects to and from rows."""

from __future__ import annotations

import dataclasses
import datetime
import enum
import inspect
import math
import re
import types
import typing
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {
    str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType(),
    datetime.datetime: T.TimestampType(), datetime.date: T.TimestampType(), typing.Any: T.StringType(), object: T.StringType(),
}
FILE = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("path", T.StringType()), ("size", T.LongType()), ("version", T.StringType()), ("etag", T.StringType()), ("is_latest", T.BooleanType()), ("last_modified", T.TimestampType()), ("location", T.StringType()))])
HIDDEN = ("source", "version", "etag", "is_latest", "last_modified", "location")


def model_fields(hint) -> dict | None:
    """Fields of a pydantic model or a dataclass, else None."""
    if not inspect.isclass(hint):
        return None
    if hasattr(hint, "model_fields"):
        return {k: f.annotation for k, f in hint.model_fields.items()}
    return typing.get_type_hints(hint) if dataclasses.is_dataclass(hint) else None


def spark_type(hint) -> T.DataType:
    if isinstance(hint, T.DataType):
        return hint
    if (simple := _SIMPLE.get(hint)) if not isinstance(hint, (list, dict)) else None:
        return simple
    if (fields := model_fields(hint)) is not None:
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in fields.items()])
    if inspect.isclass(hint) and issubclass(hint, enum.Enum):
        return T.StringType()
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return spark_type(rest[0])
        if all(a is str or typing.get_origin(a) is typing.Literal for a in rest):
            return T.StringType()
        raise TypeError(f"no column type for {hint}")
    if origin is typing.Literal:
        return T.StringType() if isinstance(args[0], str) else spark_type(type(args[0]))
    if origin is typing.Annotated:
        return spark_type(args[0])
    if origin is list or hint is list:
        return T.ArrayType(spark_type(args[0]) if args else T.StringType())
    if origin is tuple:
        kinds = {repr(spark_type(a)): spark_type(a) for a in args if a is not Ellipsis}
        return T.ArrayType(next(iter(kinds.values())) if len(kinds) == 1 else T.StringType())
    if origin is dict or hint is dict:
        return T.MapType(*(spark_type(a) for a in args)) if args else T.MapType(T.StringType(), T.StringType())
    raise TypeError(f"no column type for {hint}")


def type_of_values(values) -> T.DataType:
    """The type of the first value that isn't None; text where all are."""
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool):
            return T.BooleanType()
        if model_fields(type(v)) is not None:
            return spark_type(type(v))
        if isinstance(v, (list, tuple)):
            return T.ArrayType(type_of_values(x for w in values if w for x in w))
        if isinstance(v, dict):
            return T.MapType(T.StringType(), type_of_values(x for w in values if w for x in w.values()))
        return spark_type(type(v) if type(v) in _SIMPLE else float if hasattr(v, "dtype") and v.dtype.kind == "f" else int if hasattr(v, "dtype") else type(v))
    return T.StringType()


def plain(v):
    """A value as Spark takes it: models as dicts, NaN as null, numpy scalars as Python's."""
    if v is None or isinstance(v, (str, bool, int, bytes)):
        return v.value if isinstance(v, enum.Enum) else v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, enum.Enum):
        return v.value
    if hasattr(v, "model_fields"):
        return {k: plain(getattr(v, k)) for k in type(v).model_fields}
    if dataclasses.is_dataclass(v):
        return {f.name: plain(getattr(v, f.name)) for f in dataclasses.fields(v)}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return v


def as_object(v, hint):
    """A row value as the parameter's hint wants it: structs as models, where it names one."""
    if isinstance(v, dict) and (fields := model_fields(hint)) is not None:
        return hint(**{k: as_object(v.get(k), t) for k, t in fields.items()})
    return v


def normal_name(name: str) -> str:
    """A column name of outside data: lower case, words joined by underscores."""
    new = re.sub(r"\W+", "_", re.sub(r"^\W+|\W+$", "", name.strip())).lower()
    return f"c{new}" if not new or new[0].isdigit() else new


def normal_names(names: list[str]) -> dict[str, str]:
    """New names by old; a number tells apart those that become equal."""
    out: dict[str, str] = {}
    for old in names:
        base = new = normal_name(old)
        n = 0
        while new in out.values():
            n += 1
            new = f"{base}_{n}"
        out[old] = new
    return out


def leaves(schema: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.DataType]]:
    """(dotted name, type) of the columns below all structs."""
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, f"{prefix}{f.name}.")
        else:
            yield prefix + f.name, f.dataType


def field_type(schema: T.StructType, name: str) -> T.DataType:
    """The type of a dotted name; a KeyError names what isn't there."""
    kind: T.DataType = schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            raise KeyError(f"no column {name!r}: {part!r} not found")
        kind = kind[part].dataType
    return kind


def flat(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct leaves as columns of their own."""
    return df.select(*[F.col(n).alias(n.replace(".", sep)) for n, _ in leaves(df.schema)])


def nested(names: list[str], value) -> list[Column]:
    """Columns for dotted names, those of one root as a struct that holds only them; ``value`` makes the leaves."""
    tree: dict = {}
    for n in names:
        at = tree
        *path, last = n.split(".")
        for part in path:
            at = at.setdefault(part, {})
        at[last] = n

    def build(node, label):
        return (value(node) if isinstance(node, str) else F.struct(*[build(v, k) for k, v in node.items()])).alias(label)

    return [build(v, k) for k, v in tree.items()]


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null where floats come in."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df
