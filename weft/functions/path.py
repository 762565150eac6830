"""Parts of slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import to_column


def parent(col) -> Column:
    c = to_column(col)
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/+[^/]*$", "")).when(c.isNotNull(), "")


def name(col) -> Column:
    return F.substring_index(to_column(col), "/", -1)


def file_stem(col) -> Column:
    return F.regexp_replace(name(col), r"\.+[^.]*$", "")


def file_ext(col) -> Column:
    n = name(col)
    return F.when(F.instr(n, ".") > 0, F.substring_index(n, ".", -1)).when(n.isNotNull(), "")
