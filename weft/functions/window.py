"""Windows of one partition column and one order column."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec

from ..columns import to_column


def window(partition_by, order_by, desc: bool = False) -> WindowSpec:
    key = to_column(order_by)
    return Window.partitionBy(to_column(partition_by)).orderBy(key.desc() if desc else key.asc())


def over(func: Column, spec: WindowSpec) -> Column:
    return func.over(spec)
