"""Merges, differences and set operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import C, to_column


def _list(keys) -> list:
    return [keys] if isinstance(keys, (str, C, Column)) else list(keys)


def _renamed(left: DataFrame, right: DataFrame, rname: str) -> dict[str, str]:
    """New names of the right side's columns: those that collide get a prefix, then a number."""
    taken, out = {c.lower() for c in left.columns}, {}
    for c in right.columns:
        new = base = c if c.lower() not in taken else rname + c
        n = 0
        while new.lower() in taken:
            n += 1
            new = f"{base}_{n}"
        taken.add(new.lower())
        out[c] = new
    return out


def _how(inner: bool, full: bool) -> str:
    if inner and full:
        raise ValueError("a merge is inner or full, not both")
    return "inner" if inner else "full" if full else "left"


def _keyed(df: DataFrame, keys: Sequence, prefix: str) -> tuple[DataFrame, list[str]]:
    names = [f"__{prefix}{i}" for i in range(len(keys))]
    return df.withColumns({n: to_column(k) for n, k in zip(names, keys)}), names


def merge(left: DataFrame, right: DataFrame, on, right_on=None, inner: bool = False, full: bool = False, rname: str = "right_") -> DataFrame:
    """Equi-join, left outer by default, on names or expressions; nulls match nothing."""
    lk, rk = _list(on), _list(on if right_on is None else right_on)
    if not lk or len(lk) != len(rk):
        raise ValueError("on and right_on must name as many keys, at least one")
    names = _renamed(left, right, rname)
    l, ln = _keyed(left, lk, "l")
    r, rn = _keyed(right, rk, "r")
    r = r.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *rn)
    cond = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(ln, rn)])
    return l.join(r, cond, _how(inner, full)).drop(*ln, *rn)


def theta_join(left: DataFrame, right: DataFrame, predicate: Callable, inner: bool = False, full: bool = False, rname: str = "right_") -> DataFrame:
    """Join on ``predicate(l, r)``, where l("a") and r("b") are the two sides' columns."""
    names = _renamed(left, right, rname)
    a, b = left.alias("weft_l"), right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("weft_r")
    root = lambda name: names[name.split(".")[0]] + name[len(name.split(".")[0]) :]
    cond = predicate(lambda n: F.col(f"weft_l.{n}"), lambda n: F.col(f"weft_r.{root(n)}"))
    return a.join(b, cond, _how(inner, full))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION ALL by name."""
    only = [sorted(set(a.columns) - set(b.columns)) for a, b in ((left, right), (right, left))]
    if any(only):
        raise ValueError("; ".join(f"{', '.join(x)} only in the {side}" for x, side in zip(only, ("left", "right")) if x))
    return left.unionByName(right)


def subtract(left: DataFrame, right: DataFrame, on=None, right_on=None) -> DataFrame:
    """Rows of the left side without a partner; nulls are equal. Keys are the common columns unless given."""
    if on is None:
        on = right_on = [c for c in left.columns if c in right.columns]
        if not on:
            raise ValueError("the two sides have no column in common")
    lk, rk = _list(on), _list(on if right_on is None else right_on)
    if not lk or len(lk) != len(rk):
        raise ValueError("on and right_on must name as many keys, at least one")
    l, ln = _keyed(left, lk, "l")
    r = right.select(*[to_column(k).alias(f"__r{i}") for i, k in enumerate(rk)])
    cond = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__r{i}")) for i, n in enumerate(ln)])
    return l.join(r, cond, "left_anti").drop(*ln)


def diff(left: DataFrame, right: DataFrame, on, right_on=None, compare=None, right_compare=None, added: bool = True, deleted: bool = True, modified: bool = True, same: bool = False, status_col: str | None = None) -> DataFrame:
    """Rows of the left side added to, modified or same as in the right, and deleted ones with their keys alone.

    Each row comes once, also where keys repeat: it is the same if the right side has its key with like values in any row.
    A row is modified where a compared value differs; null against a value does not. Without ``compare`` the common
    columns count, and all matches are modified if the sides have different numbers of columns.
    """
    if not (added or deleted or modified or same):
        raise ValueError("at least one of added, deleted, modified and same is needed")
    lk, rk = _list(on), _list(on if right_on is None else right_on)
    if not lk or len(lk) != len(rk):
        raise ValueError("on and right_on must name as many keys, at least one")
    every = compare is None and len(left.columns) != len(right.columns)
    if compare is None:
        lc = rc = [c for c in left.columns if c in right.columns and c not in lk]
    else:
        lc, rc = _list(compare), _list(compare if right_compare is None else right_compare)
        if len(lc) != len(rc):
            raise ValueError("compare and right_compare must name as many columns")
    l, ln = _keyed(left.withColumn("__in_l", F.lit(1)), lk, "l")
    l, lv = _keyed(l, lc, "lv")
    rn = [f"__r{i}" for i in range(len(rk))]
    r = right.select(*[to_column(k).alias(n) for k, n in zip(rk, rn)], F.struct(F.lit(1).alias("x"), *[to_column(c).alias(f"v{i}") for i, c in enumerate(rc)]).alias("__rv"))
    known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in rn])  # null keys meet no row
    r = r.groupBy(*rn).agg(F.count("*").alias("__in_r"), F.collect_set(F.when(known, F.col("__rv"))).alias("__rvs"))
    cond = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(ln, rn)])
    how = "full" if deleted and (added or modified or same) else "right" if deleted else "left"
    like = lambda v: reduce(lambda a, b: a & b, [F.coalesce(F.col(n) == v[f"v{i}"], F.lit(True)) for i, n in enumerate(lv)])
    unlike = F.lit(True) if every else ~F.exists("__rvs", like) if lv else F.lit(False)
    status = F.when(F.col("__in_r").isNull(), "A").when(F.col("__in_l").isNull(), "D").when(unlike, "M").otherwise("S")
    wanted = [s for s, w in zip("ADMS", (added, deleted, modified, same)) if w]
    both = l.join(r, cond, how).withColumn("__status", status).where(F.col("__status").isin(wanted))
    if deleted:  # as often as the right side has them, by blocks of 65,536
        n = F.when(F.col("__status") == "D", F.col("__in_r")).otherwise(F.lit(1))
        both = both.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(n - 1, 16))))
        both = both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1 << 16), n - F.shiftleft("__block", 16)))))
    keys = {k if isinstance(k, str) else getattr(k, "name", None): F.coalesce(F.col(f"__l{i}"), F.col(f"__r{i}")) for i, k in enumerate(lk)}
    out = []
    for f in left.schema:
        inside = {k[len(f.name) + 1 :]: v for k, v in keys.items() if k and k.startswith(f.name + ".")}
        c = keys.get(f.name, F.col(f"`{f.name}`"))
        if inside and isinstance(f.dataType, T.StructType):
            c = F.struct(*[(inside.get(x) if x in inside else F.col(f"`{f.name}`").getField(x)).alias(x) for x in f.dataType.fieldNames()])
        out.append(c.alias(f.name))
    return both.select(*out, *([F.col("__status").alias(status_col)] if status_col else []))
