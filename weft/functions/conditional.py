"""Conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import to_column


def _extreme(f, args) -> Column:
    """Spark's skip nulls; here one null makes the result null."""
    if len(args) < 2:
        raise ValueError("at least two arguments are needed")
    columns = [to_column(a) for a in args]
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]), f(*columns))


def greatest(*args) -> Column:
    return _extreme(F.greatest, args)


def least(*args) -> Column:
    return _extreme(F.least, args)


def case(*branches: tuple, else_=None) -> Column:
    """The value of the first condition that holds; string values are literals."""
    if not branches:
        raise ValueError("case() needs a branch")
    out = F
    for cond, value in branches:
        out = out.when(to_column(cond), to_column(value, names=False))
    return out.otherwise(to_column(else_, names=False))


def ifelse(cond, if_value, else_value) -> Column:
    return case((cond, if_value), else_=else_value)


def isnone(col) -> Column:
    return to_column(col).isNull()


def or_(*args) -> Column:
    return reduce(lambda a, b: a | b, map(to_column, args))


def and_(*args) -> Column:
    return reduce(lambda a, b: a & b, map(to_column, args))


def not_(arg) -> Column:
    return ~to_column(arg)
