"""Column references by dotted name, and the predicates that Spark has no name for."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``*`` also crosses ``/``; case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            not_ = body.startswith("^")
            out.append("[" + "^" * not_ + re.sub(r"([\[\]\\&^])", r"\\\1", body[not_:]) + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s/])", r"\\\1", c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


class C:
    """A column of the chain by its dotted name; used bare in ``mutate`` it renames."""

    def __init__(self, name: str):
        self.name = name

    @property
    def column(self) -> Column:
        return F.col(self.name)

    def glob(self, pattern: str) -> Column:
        return self.column.rlike(glob_regex(pattern))

    def regexp(self, pattern: str) -> Column:
        return self.column.rlike(pattern)

    def in_(self, values) -> Column:
        return self.column.isin(list(values))

    def not_in(self, values) -> Column:
        return ~self.column.isin(list(values))

    def is_(self, value) -> Column:
        return self.column.isNull() if value is None else self.column.eqNullSafe(value)

    def is_not(self, value) -> Column:
        return ~self.is_(value)

    def __getattr__(self, name: str):
        return getattr(self.column, name)

    def __hash__(self):
        return hash(self.name)

    def __invert__(self):
        return ~self.column

    def __neg__(self):
        return -self.column

    def __repr__(self):
        return f"C({self.name!r})"


def _both(name: str):
    def apply(self, other):
        return getattr(operator, name)(self.column, to_column(other, names=False))

    def reflected(self, other):
        return getattr(operator, name)(F.lit(other), self.column)

    return apply, reflected


for _op in ("add", "sub", "mul", "truediv", "mod", "and_", "or_"):
    _name = _op.rstrip("_")
    _fwd, _back = _both(_op)
    setattr(C, f"__{_name}__", _fwd)
    setattr(C, f"__r{_name}__", _back)
def _bits(apply):
    def forward(self, other):
        return apply(self.column, to_column(other, names=False))

    def reflected(self, other):
        return apply(F.lit(other), self.column)

    return forward, reflected


def _shift(function):
    """Shifts take a number of places that is an int; a column of them goes through SQL's function."""
    return lambda a, b: F.call_function(function, a.cast("long"), b.cast("int"))


for _name, _apply in {"floordiv": lambda a, b: F.call_function("div", a, b), "xor": lambda a, b: a.bitwiseXOR(b), "lshift": _shift("shiftleft"), "rshift": _shift("shiftright")}.items():
    _fwd, _back = _bits(_apply)
    setattr(C, f"__{_name}__", _fwd)
    setattr(C, f"__r{_name}__", _back)
for _op in ("lt", "le", "eq", "ne", "gt", "ge"):
    setattr(C, f"__{_op}__", _both(_op)[0])


def to_column(value, names: bool = True) -> Column:
    """A Column from a Column, a C, a name (if ``names``) or a literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, C):
        return value.column
    if names and isinstance(value, str):
        return F.col(value)
    return F.lit(value)
