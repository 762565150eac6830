"""Runs over what changed since the last one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import _list, diff, merge, subtract, union


class SchemaDriftError(ValueError):
    """A run over changed rows gives other columns than the saved result has."""


@dataclass(frozen=True)
class Delta:
    """How a chain reads its source incrementally."""

    on: tuple[str, ...]
    result_on: tuple[str, ...]
    compare: tuple[str, ...] | None = None
    retry: str | bool | None = None
    unsafe: bool = False


def changed(new: DataFrame, old: DataFrame, delta: Delta) -> DataFrame:
    """Rows added or modified since the older version."""
    return diff(new, old, list(delta.on), compare=list(delta.compare) if delta.compare is not None else None, deleted=False)


def to_retry(source: DataFrame, result: DataFrame, delta: Delta) -> DataFrame:
    """Source rows whose result has an error, or (``retry=True``) that have no result."""
    if isinstance(delta.retry, str):
        failed = result.where(F.col(delta.retry).isNotNull() & (F.col(delta.retry).cast("string") != "")).select(*[F.col(k).alias(f"__e{i}") for i, k in enumerate(delta.result_on)]).distinct()
        keyed = merge(source, failed, list(delta.on), [f"__e{i}" for i in range(len(delta.on))], inner=True)
        return keyed.select(*source.columns)
    return subtract(source, result, list(delta.on), list(delta.result_on))


def due(source: DataFrame, before: DataFrame, result: DataFrame, delta: Delta) -> DataFrame:
    """All rows to process now, each once."""
    fresh = changed(source, before, delta)
    if not delta.retry:
        return fresh
    again = to_retry(source, result, delta)
    return union(fresh, subtract(again, fresh, list(delta.on)))


def combined(result: DataFrame, processed: DataFrame, delta: Delta) -> DataFrame:
    """The old result without the keys that were processed, and what they gave now."""
    kinds = [{f.name: f.dataType for f in df.schema} for df in (result, processed)]
    if kinds[0] != kinds[1]:
        apart = sorted(k for k in kinds[0].keys() | kinds[1].keys() if kinds[0].get(k) != kinds[1].get(k))
        raise SchemaDriftError(f"columns differ from the saved result: {', '.join(apart)}")
    return union(subtract(result, processed, list(delta.result_on)), processed)


def keys(value) -> tuple[str, ...]:
    return tuple(_list(value))


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], T.StructType(df.schema.fields))
