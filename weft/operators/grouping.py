"""Grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import C, to_column
from ..schema import field_type, nested


def key_list(keys) -> list:
    return [] if keys is None else [keys] if isinstance(keys, (str, C, Column)) else list(keys)


def keyed(df: DataFrame, keys) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with each key as a column, those columns' names and the (dotted) names that the keys have."""
    names = []
    for k in key_list(keys):
        if isinstance(k, Column):
            names.append(df.select(k).columns[0])
        else:
            names.append(k if isinstance(k, str) else k.name)
            field_type(df.schema, names[-1])
    held = [f"__k{i}" for i in range(len(names))]
    return df.withColumns({h: to_column(k) for h, k in zip(held, key_list(keys))}), held, names


def key_columns(held: list[str], names: list[str]) -> list[Column]:
    """The keys by name; nested ones as structs of the grouped leaves alone."""
    plain = {n: h for n, h in zip(names, held)}
    expressions = {n for n in names if not n.replace(".", "").replace("_", "").isalnum()}
    return nested([n for n in names if n not in expressions], lambda n: F.col(plain[n])) + [F.col(plain[n]).alias(n) for n in names if n in expressions]


def group_by(df: DataFrame, partition_by=None, **aggregates: Column) -> DataFrame:
    if not aggregates:
        raise ValueError("group_by needs an aggregate")
    held_df, held, names = keyed(df, partition_by)
    by = held_df.groupBy(*held).agg(*[a.alias(n) for n, a in aggregates.items()])
    return by.select(*key_columns(held, names), *[F.col(f"`{n}`") for n in aggregates])
