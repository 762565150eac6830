"""Aggregates and ranking functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import to_column


def count(col=None) -> Column:
    """Rows, or the non-null values of a column."""
    return F.count("*") if col is None else F.count(to_column(col))


def sum(col) -> Column:
    return F.sum(to_column(col))


def avg(col) -> Column:
    return F.avg(to_column(col))


def min(col) -> Column:
    return F.min(to_column(col))


def max(col) -> Column:
    return F.max(to_column(col))


def any_value(col) -> Column:
    return F.any_value(to_column(col))


def collect(col) -> Column:
    """Values of a group in ascending order, nulls kept and first: a fixed result however rows are spread."""
    return F.transform(F.sort_array(F.collect_list(F.struct(to_column(col).alias("x")))), lambda s: s["x"])


def concat(col, separator: str = "") -> Column:
    """Strings of a group joined in ascending order, nulls skipped."""
    return F.array_join(F.sort_array(F.collect_list(to_column(col))), separator)


def row_number() -> Column:
    return F.row_number()


def rank() -> Column:
    return F.rank()


def dense_rank() -> Column:
    return F.dense_rank()


def first(col) -> Column:
    return F.first(to_column(col))
