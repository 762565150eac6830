"""Random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rand() -> Column:
    """A random signed 64-bit integer for each row."""
    return F.xxhash64(F.uuid())
