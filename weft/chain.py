"""The fluent API: a chain wraps a DataFrame, pending order and limits, and the operations that made it."""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as schemas
from . import sinks
from .columns import C, to_column
from .operators import grouping, joins, rows, udf
from .plans.catalog import Catalog, DatasetNotFoundError, Name
from .plans.incremental import Delta, combined, due, has_rows, keys
from .storage import stored

GUARDED = {"merge", "join", "union", "distinct", "agg", "group_by"}


def step(method):
    """Records the call, so that a saved result can be brought up to date by replaying it on changed rows."""

    @functools.wraps(method)
    def call(self, *args, **kwargs):
        if self._delta and not self._delta.unsafe and method.__name__ in GUARDED:
            raise NotImplementedError(f"{method.__name__} on a delta chain needs delta_unsafe=True")
        out = method(self, *args, **kwargs)
        out._ops = (*self._ops, (method.__name__, args, kwargs))
        others = [a for a in args if isinstance(a, Chain)]
        out._sources = (*out._sources, *(s for o in others for s in o._sources if s not in out._sources))
        return out

    return call


def _fingerprint(x) -> str:
    if isinstance(x, Chain):
        return x.hash()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_fingerprint, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{_fingerprint(v)}" for k, v in sorted(x.items())) + "}"
    if callable(x) and not isinstance(x, (Column, C)):
        try:
            return inspect.getsource(x if inspect.isroutine(x) or inspect.isclass(x) else type(x))
        except (OSError, TypeError):
            code = getattr(x, "__code__", None)
            return f"{code.co_code!r}{code.co_consts!r}" if code else repr(type(x))
    return repr(x)


class Chain:
    """Every method returns a new chain; nothing runs before an action."""

    def __init__(self, df: DataFrame, catalog: Catalog | None = None):
        self._df, self._catalog = df, catalog
        self._order: tuple = ()
        self._limit: int | None = None
        self._offset = 0
        self._ops: tuple = ()
        self._setup: dict[str, Callable] = {}
        self._settings: dict = {}
        self._sources: tuple = ()
        self._delta: Delta | None = None
        self._dataset: tuple[Name, str] | None = None

    def _next(self, df: DataFrame | None = None, **changes) -> Chain:
        out = Chain.__new__(Chain)
        out.__dict__.update(self.__dict__ | {"_dataset": None} | changes)
        if df is not None:
            out._df = df
        return out

    @property
    def df(self) -> DataFrame:
        """The rows with order, offset and limit applied."""
        out = self._df.orderBy(*self._order) if self._order else self._df
        out = out.offset(self._offset) if self._offset else out
        return out if self._limit is None else out.limit(self._limit)

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    @property
    def catalog(self) -> Catalog:
        return self._catalog or Catalog(self.spark)

    def _sliced(self) -> Chain:
        """Limits applied, so that what follows sees the rows that remain; the order stays pending."""
        if self._limit is None and not self._offset:
            return self
        return self._next(self.df, _limit=None, _offset=0)

    def _settled(self) -> Chain:
        return self._next(self.df, _order=(), _limit=None, _offset=0)

    def _visible(self) -> DataFrame:
        """Without system columns, unless the settings ask for them."""
        df = self.df
        return df if self._settings.get("sys") or "sys" not in df.columns else df.drop("sys")

    @property
    def ordered_select(self) -> DataFrame:
        """The visible rows in the order given, for an ordered scan."""
        return self._visible()

    # -- identity -----------------------------------------------------------

    @property
    def schema(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self._df.schema if f.name != "sys" or self._settings.get("sys")}

    def print_schema(self) -> None:
        self._visible().printSchema()

    def __repr__(self) -> str:
        return self._visible()._jdf.schema().treeString() if self.schema else "empty chain"

    @property
    def dataset(self) -> str | None:
        return str(self._dataset[0]) if self._dataset else None

    name = dataset

    @property
    def version(self) -> str | None:
        return self._dataset[1] if self._dataset else None

    @property
    def namespace_name(self) -> str:
        return self._dataset[0].namespace if self._dataset else self._settings.get("namespace", "local")

    @property
    def project_name(self) -> str:
        return self._dataset[0].project if self._dataset else self._settings.get("project", "local")

    def hash(self) -> str:
        """Of the sources and the operations; columns count by their expressions, functions by their source."""
        base = _fingerprint([list(self._sources), self._df.schema.simpleString() if not self._ops else "", [list(o) for o in self._ops]])
        return hashlib.sha256(base.encode()).hexdigest()

    def column(self, name: str) -> Column:
        schemas.field_type(self._df.schema, name)
        return F.col(name)

    c = column

    def clone(self) -> Chain:
        return self._next()

    def apply(self, func: Callable, *args, **kwargs):
        return func(self, *args, **kwargs)

    def settings(self, cache=None, prefetch=None, parallel=None, workers=None, namespace=None, project=None, min_task_size=None, batch_size=None, sys=None) -> Chain:
        """``parallel`` or ``workers`` spread rows over so many tasks before a Python function; the rest are hints."""
        given = {k: v for k, v in locals().items() if k != "self" and v is not None}
        return self._next(_settings=self._settings | given)

    def reset_settings(self) -> Chain:
        return self._next(_settings={})

    def setup(self, **values: Callable) -> Chain:
        """Values built once in each task and passed to Python functions by parameter name."""
        again = set(values) & set(self._setup)
        if again:
            raise ValueError(f"already set up: {sorted(again)}")
        if not all(callable(v) for v in values.values()):
            raise ValueError("setup takes functions")
        return self._next(_setup=self._setup | values)

    # -- projection, filter, order -------------------------------------------

    @step
    def select(self, *names: str) -> Chain:
        for n in names:
            schemas.field_type(self._df.schema, n)
        own = self._settled()
        keep = ["sys"] if "sys" in own._df.columns and "sys" not in {n.split(".")[0] for n in names} else []
        return own._next(own._df.select(*keep, *schemas.nested(list(names), F.col)))

    @step
    def select_except(self, *names: str) -> Chain:
        missing = [n for n in names if n not in self._df.columns]
        if missing:
            raise KeyError(f"no top-level columns {missing}")
        own = self._settled()
        return own._next(own._df.drop(*names))

    @step
    def mutate(self, **values) -> Chain:
        """Adds or replaces columns, all computed from the input; a bare C renames a top-level column.

        ``struct.field`` names replace a field of a struct, which must be there and keep its type.
        """
        own = self._sliced()
        if any(n.split(".")[0] in {str(k) for k in own._order} for n in values):
            own = own._settled()
        df, drop, new = own._df, [], {}
        for name, v in values.items():
            column = to_column(v, names=False)
            if isinstance(v, C):
                schemas.field_type(df.schema, v.name)
                if "." not in v.name and v.name not in values and v.name != name:
                    drop.append(v.name)
            root, _, inner = name.partition(".")
            if inner:
                kind = schemas.field_type(df.schema, name)
                if (got := df.select(column).schema[0].dataType) != kind:
                    raise TypeError(f"{name} is {kind.simpleString()}, not {got.simpleString()}")
                new[root] = new.get(root, F.col(root)).withField(inner, column)
            else:
                new[name] = column
        return own._next(df.withColumns(new).drop(*drop))

    @step
    def filter(self, *predicates) -> Chain:
        own = self._sliced()
        df = own._df
        for p in predicates:
            df = df.where(to_column(p))
        return own._next(df)

    @step
    def order_by(self, *cols, descending: bool = False) -> Chain:
        """Sorts after the keys of earlier calls; nulls are least."""
        own = self._sliced()
        by = [to_column(k) for k in cols]
        return own._next(_order=(*own._order, *[k.desc() if descending else k for k in by]))

    @step
    def limit(self, n: int) -> Chain:
        return self._next(_limit=n if self._limit is None else min(n, self._limit))

    @step
    def offset(self, n: int) -> Chain:
        """Skips n rows, before any limit."""
        return self._next(_offset=self._offset + n)

    @step
    def distinct(self, *cols: str) -> Chain:
        """One row for each value of the columns; which one is not defined."""
        own = self._sliced()
        if not cols:
            return own._next(own._df.drop("sys").distinct())
        held, names, _ = grouping.keyed(own._df, list(cols))
        return own._next(held.dropDuplicates(names).drop(*names))

    @step
    def sample(self, n: int, seed: int | None = None) -> Chain:
        """Exactly n rows, or all."""
        own = self._settled()
        return own._next(own._df.orderBy(F.rand(seed)).limit(n))

    @step
    def shuffle(self) -> Chain:
        """In the order of random numbers that stay with the rows."""
        return self._next(self._with_sys()._df, _order=(F.col("sys.rand"),), _limit=None, _offset=0)

    def _with_sys(self, again: bool = False) -> Chain:
        if "sys" in self._df.columns and not again:
            return self._sliced()
        own = self._sliced()
        return own._next(rows.with_sys(own._df, list(own._order)))

    @step
    def chunk(self, index: int, total: int) -> Chain:
        """A part of the rows, disjoint from the others; a limit before it is divided among the parts."""
        base = self._next(_limit=None)._with_sys()
        out = base._next(rows.chunk(base._df, index, total))
        return out if self._limit is None else out._next(_limit=rows.chunk_limit(self._limit, index, total))

    @step
    def explode(self, col: str, column: str | None = None, schema_sample_size: int | None = None) -> Chain:
        """A JSON string as a typed struct column ``<col>_expl``; the schema comes from all its values or, by
        ``schema_sample_size``, from so many of them: keys and types first seen later are then lost."""
        own = self._sliced()
        texts = own._df.where(F.col(col).isNotNull()).select(F.col(col).alias("j"))
        texts = texts if schema_sample_size is None else texts.limit(schema_sample_size)
        # the reader takes a Dataset[String], which stays in the JVM
        strings = getattr(texts._jdf, "as")(self.spark._jvm.org.apache.spark.sql.Encoders.STRING())
        kind = T.StructType.fromJson(json.loads(self.spark._jsparkSession.read().json(strings).schema().json()))
        return own._next(own._df.withColumn(column or col.split(".")[-1] + "_expl", F.from_json(F.col(col), kind)))

    # -- joins and sets -------------------------------------------------------

    def _bare(self) -> DataFrame:
        return self.df.drop("sys")

    @step
    def merge(self, right: Chain, on, right_on=None, inner: bool = False, full: bool = False, rname: str = "right_") -> Chain:
        return self._settled()._next(joins.merge(self._bare(), right._bare(), on, right_on, inner, full, rname))

    @step
    def join(self, right: Chain, predicate: Callable, inner: bool = False, full: bool = False, rname: str = "right_") -> Chain:
        return self._settled()._next(joins.theta_join(self._bare(), right._bare(), predicate, inner, full, rname))

    @step
    def union(self, other: Chain) -> Chain:
        return self._settled()._next(joins.union(self._bare(), other._bare()))

    __or__ = union

    @step
    def subtract(self, other: Chain, on=None, right_on=None) -> Chain:
        return self._settled()._next(joins.subtract(self._bare(), other._bare(), on, right_on))

    @step
    def diff(self, other: Chain, on, right_on=None, compare=None, right_compare=None, added=True, deleted=True, modified=True, same=False, status_col=None) -> Chain:
        return self._settled()._next(joins.diff(self._bare(), other._bare(), on, right_on, compare, right_compare, added, deleted, modified, same, status_col))

    def file_diff(self, other: Chain, on: str = "file", right_on: str | None = None, **kwargs) -> Chain:
        """Differences of file columns: keyed by source and path, compared by version and etag."""
        r = right_on or on
        parts = lambda root, names: [f"{root}.{n}" for n in names]
        return self.diff(other, parts(on, ("source", "path")), parts(r, ("source", "path")), parts(on, ("version", "etag")), parts(r, ("version", "etag")), **kwargs)

    def compare_and_split(self, other: Chain, on, right_on=None, compare=None, right_compare=None) -> dict[str, Chain]:
        """Chains of added (A), deleted (D), modified (M) and same (S) rows, of one stored comparison."""
        both = stored(joins.diff(self._bare(), other._bare(), on, right_on, compare, right_compare, same=True, status_col="__s"), "diff")
        return {s: self._settled()._next(both.where(F.col("__s") == s).drop("__s")) for s in "ADMS"}

    # -- groups and functions -------------------------------------------------

    @step
    def group_by(self, *, partition_by=None, **aggregates: Column) -> Chain:
        own = self._settled()
        return own._next(grouping.group_by(own._df.drop("sys"), partition_by, **aggregates))

    def _plan(self, df, func, params, output, named, many) -> udf.Plan:
        return udf.Plan(df, func, params, output, named, self._setup, many)

    def _spread(self) -> Chain:
        own = self._settled() if self._limit is not None or self._offset else self
        n = self._settings.get("workers") or self._settings.get("parallel")
        return own._next(own._df.repartition(int(n))) if n and n is not True and int(n) > 1 else own

    @step
    def map(self, func=None, params=None, output=None, **named) -> Chain:
        own = self._spread()
        return own._next(udf.map_rows(own._df, self._plan(own._df, func, params, output, named, False)))

    @step
    def gen(self, func=None, params=None, output=None, **named) -> Chain:
        own = self._spread()._settled()
        return own._next(udf.generate(own._df, self._plan(own._df, func, params, output, named, True)))

    @step
    def agg(self, func=None, partition_by=None, params=None, output=None, **named) -> Chain:
        own = self._settled()
        return own._next(udf.aggregate(own._df, self._plan(own._df, func, params, output, named, True), partition_by))

    @step
    def batch_map(self, func=None, params=None, output=None, batch: int = 1000, **named) -> Chain:
        own = self._spread()
        return own._next(udf.batch_map(own._df, self._plan(own._df, func, params, output, named, True), batch))

    # -- results --------------------------------------------------------------

    def count(self) -> int:
        return self.df.count()

    @property
    def empty(self) -> bool:
        return self.df.isEmpty()

    def _scalar(self, f: Callable, col: str):
        return self.df.agg(f(to_column(col))).first()[0]

    def sum(self, col: str):
        return self._scalar(F.sum, col)

    def avg(self, col: str):
        return self._scalar(F.avg, col)

    def min(self, col: str):
        return self._scalar(F.min, col)

    def max(self, col: str):
        return self._scalar(F.max, col)

    def _chosen(self, cols: tuple[str, ...]) -> DataFrame:
        return self.df.select(*[F.col(c) for c in cols]) if cols else self._visible()

    def to_iter(self, *cols: str) -> Iterator[tuple]:
        """Rows as tuples; null floats are NaN, structs are rows."""
        df = self._chosen(cols)
        floats = [isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema]
        for r in df.toLocalIterator():
            yield tuple(float("nan") if v is None and is_float else v for v, is_float in zip(r, floats))

    __iter__ = to_iter

    def to_list(self, *cols: str) -> list[tuple]:
        return list(self.to_iter(*cols))

    def to_values(self, col: str) -> list:
        return [r[0] for r in self.to_iter(col)]

    def extract(self, *cols: str) -> Iterator[tuple]:
        """The values of columns, a tuple a row."""
        return self.to_iter(*cols)

    def leaf_values(self) -> Iterator[tuple]:
        """Rows with structs laid flat."""
        for r in self._flat(True).toLocalIterator():
            yield tuple(r)

    _leaf_values = leaf_values
    collect = to_list

    def as_scalar(self):
        """The first value of the first row."""
        row = self._visible().first()
        return None if row is None else row[0]

    def to_pytorch(self, transform: Callable | None = None, num_samples: int = 0):
        """An iterable PyTorch dataset of rows, streamed a partition at a time; needs torch."""
        from torch.utils.data import IterableDataset

        chain = self.sample(num_samples) if num_samples else self

        class Rows(IterableDataset):
            def __iter__(self):
                return (transform(r) if transform else r for r in chain.to_iter())

        return Rows()

    def parse_tabular(self, output=None, column: str = "", model: str = "file", source: bool = False, nrows: int | None = None, format: str | None = None, **options) -> Chain:
        """Rows of the tables (CSV, JSON lines, Parquet) that a file column names, read where Arrow opens them."""
        from .sources import tabular

        return self._settled()._next(tabular.parse(self.df, output, column, model, source, nrows, format, options))

    def results(self, include_hidden: bool = True) -> list[tuple]:
        return [tuple(r) for r in self._flat(include_hidden).collect()]

    def to_records(self) -> list[dict]:
        return [dict(zip((c.replace(".", "__") for c in df.columns), r)) for df in [self._flat(True)] for r in df.collect()]

    def _flat(self, include_hidden: bool) -> DataFrame:
        df = schemas.flat(self._visible())
        hidden = [c for c in df.columns if not include_hidden and c.rpartition(".")[2] in schemas.HIDDEN and f"{c.rpartition('.')[0]}.path" in df.columns]
        return df.drop(*[f"`{c}`" for c in hidden]) if not hidden else df.select(*[F.col(f"`{c}`") for c in df.columns if c not in hidden])

    def to_columnar_data_with_names(self, chunk_size: int = 100_000) -> tuple[list[str], Iterator[list[list]]]:
        """Names, and columns of values a chunk at a time; a partition at most is in the driver."""
        df = self._flat(True)

        def chunks():
            rows = df.toLocalIterator()
            while part := list(islice(rows, chunk_size)):
                yield [list(c) for c in zip(*part)]

        return df.columns, chunks()

    def to_pandas(self, flatten: bool = True, include_hidden: bool = True):
        import pandas as pd

        pdf = self._flat(include_hidden).toPandas()
        if not flatten and any("." in c for c in pdf.columns):
            parts = [c.split(".") for c in pdf.columns]
            depth = max(map(len, parts))
            pdf.columns = pd.MultiIndex.from_tuples([(*p, *[""] * (depth - len(p))) for p in parts])
        return pdf

    def show(self, limit: int = 20, flatten: bool = False, transpose: bool = False, truncate: bool = True, include_hidden: bool = False) -> None:
        pdf = self.limit(limit).to_pandas(flatten=flatten, include_hidden=include_hidden)
        text = pdf.T if transpose else pdf
        print(text.to_string(max_colwidth=40 if truncate else None) if len(pdf) else "empty result")  # noqa: T201

    def exec(self) -> Chain:
        self.df.write.format("noop").mode("overwrite").save()
        return self

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def to_parquet(self, path: str, partition_cols=None) -> None:
        sinks.to_parquet(self._visible(), path, partition_cols)

    def to_csv(self, path: str, delimiter: str = ",") -> None:
        sinks.to_csv(self._visible(), path, delimiter)

    def to_json(self, path: str, include_outer_list: bool = True) -> None:
        (sinks.to_json if include_outer_list else sinks.to_jsonl)(self._visible(), path)

    def to_jsonl(self, path: str) -> None:
        sinks.to_jsonl(self._visible(), path)

    def to_database(self, table: str, connection, **kwargs) -> int:
        return sinks.to_database(self._visible(), table, connection, **kwargs)

    def to_storage(self, output: str, signal: str = "file", **kwargs) -> int:
        return sinks.to_storage(self.df, output, signal, **kwargs)

    def persist(self) -> Chain:
        """Written to the shared folder with system columns."""
        return self._with_sys(again="sys" not in self._df.columns)

    def train_test_split(self, weights: list[float], seed: int | None = None) -> list[Chain]:
        """Disjoint parts that hold all rows."""
        rows.split_bounds(weights)
        base = self._with_sys()
        return [base.filter(c) for c in rows.split_conditions(F.col("sys.rand"), weights, seed)]

    # -- datasets -------------------------------------------------------------

    def save(self, name: str, version: str | None = None, description: str | None = None, attrs: list[str] | None = None, update_version: str = "patch", checkpoint: str | None = None) -> Chain:
        """A new version of a dataset. A delta chain processes only what changed in its source since the version the
        saved result was made from; ``checkpoint`` names a job whose equal chains are computed once."""
        cat, n = self.catalog, Name.of(name, self._settings.get("namespace"), self._settings.get("project"))
        key = hashlib.sha256(f"{checkpoint}:{n}:{self.hash()}".encode()).hexdigest()
        if checkpoint and (done := cat.checkpoint(key)):
            return read_dataset(self.spark, done["name"], f"=={done['version']}", catalog=cat)
        chain = self._incremental(cat, n) if self._delta and cat.versions(n) else self
        if chain is None:
            return read_dataset(self.spark, str(n), catalog=cat)
        df = chain._visible()
        sources = [{"name": a, "version": b} for a, b in self._sources]
        saved = cat.save(df, n, version, update_version, description, attrs, sources, self.hash())
        if checkpoint:
            cat.set_checkpoint(key, str(n), saved)
        return read_dataset(self.spark, str(n), f"=={saved}", catalog=cat)

    def _incremental(self, cat: Catalog, n: Name) -> Chain | None:
        """The result brought up to date; None if nothing changed; the chain itself if it must run in full."""
        source, now = self._sources[0]
        before = next((d["version"] for d in cat.manifest(n)["dependencies"] if d["name"] == source), None)
        if before is None or before not in cat.versions(source):
            return self
        result = cat.read(n)
        todo = stored(due(cat.read(source, f"=={now}"), cat.read(source, f"=={before}"), result, self._delta), "delta")
        if not has_rows(todo):
            return None
        replay = Chain(todo, cat)
        replay._setup, replay._settings = self._setup, self._settings
        for method, args, kwargs in self._ops:
            replay = getattr(replay, method)(*args, **kwargs)
        processed = stored(replay._visible(), "delta")
        return self._settled()._next(combined(result, processed, self._delta))


def read_dataset(spark: SparkSession, name: str, version: str | int | None = None, namespace: str | None = None, project: str | None = None, delta: bool = False, delta_on=("id",), delta_result_on=None, delta_compare=None, delta_retry: str | bool | None = None, delta_unsafe: bool = False, catalog: Catalog | None = None) -> Chain:
    """A saved version: the newest, or the newest that the version, specifier or major number allows."""
    cat = catalog or Catalog(spark)
    n, v = cat.resolve(Name.of(name, namespace, project), version)
    out = Chain(cat.read(n, f"=={v}"), cat)
    out._sources, out._dataset = ((str(n), v),), (n, v)
    if delta:
        out._delta = Delta(keys(delta_on), keys(delta_result_on or delta_on), keys(delta_compare) if delta_compare is not None else None, delta_retry, delta_unsafe)
    return out


__all__ = ["Chain", "DatasetNotFoundError", "read_dataset"]
