"""Strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import to_column


def length(col) -> Column:
    return F.length(to_column(col)).cast("long")


def split(col, sep: str, limit: int | None = None) -> Column:
    """Parts between literal separators; ``limit`` is the most splits."""
    return F.split(to_column(col), r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E", -1 if limit is None else limit + 1)


def replace(col, pattern: str, replacement: str) -> Column:
    return F.replace(to_column(col), F.lit(pattern), F.lit(replacement))


def regexp_replace(col, regex: str, replacement: str) -> Column:
    """All matches; ``\\1`` and ``\\g<1>`` refer to groups, ``$`` is itself."""
    java = re.sub(r"\\g<(\d+)>|\\(\d)|\$", lambda m: r"\$" if m.group() == "$" else "$" + (m.group(1) or m.group(2)), replacement)
    return F.regexp_replace(to_column(col), regex, java)


def byte_hamming_distance(a, b) -> Column:
    """Positions at which two strings differ, and the difference of their lengths."""
    x, y = to_column(a), to_column(b)
    n = F.least(F.length(x), F.length(y))
    unlike = F.filter(F.sequence(F.lit(1), n), lambda k: F.substr(x, k, F.lit(1)) != F.substr(y, k, F.lit(1)))
    return (F.when(n > 0, F.size(unlike)).otherwise(0) + F.abs(F.length(x) - F.length(y))).cast("long")
