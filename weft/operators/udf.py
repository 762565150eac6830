"""Python functions on rows, batches and groups, over Arrow batches; schemas come from their type hints."""

from __future__ import annotations

import inspect
import typing
from collections.abc import Iterator
from contextlib import closing
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..columns import to_column
from ..schema import as_object, field_type, model_fields, plain, spark_type
from .grouping import keyed


class UDF:
    """Base of class functions: ``setup`` and ``teardown`` run once for each task, ``process`` for each call."""

    def setup(self):
        """Called before the first row."""

    def teardown(self):
        """Called after the last."""

    def process(self, *args):
        raise NotImplementedError


class Mapper(UDF):
    """One row to one value."""


class Generator(UDF):
    """One row to any number of rows."""


class Aggregator(UDF):
    """The lists of a group's values to any number of rows."""


class BatchMapper(UDF):
    """Lists of a batch's values to as many results."""


class UserCodeError(RuntimeError):
    """A user's function raised."""


class Plan:
    """A function with its parameters, their hints and its output columns."""

    def __init__(self, df: DataFrame, func, params, output, named: dict, setup: dict, many: bool):
        if named and (func is not None or len(named) > 1):
            raise ValueError("one function at a time")
        self.name, self.func = next(iter(named.items())) if named else (None, func)
        if self.func is None:
            raise ValueError("a function is needed")
        target = self.func.process if isinstance(self.func, UDF) else self.func
        signature = inspect.signature(target)
        try:
            hints = typing.get_type_hints(target)
        except Exception:  # noqa: BLE001 - hints that name what isn't there are as good as none
            hints = dict(getattr(target, "__annotations__", {}))
        free = [p.name for p in signature.parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
        self.setup = {k: v for k, v in setup.items() if k in signature.parameters}
        given = [params] if isinstance(params, str) else list(params or [])
        self.params = given or [p for p in free if p not in self.setup]
        for p in self.params:
            field_type(df.schema, p)
        positional = [p for p in signature.parameters if p not in self.setup]
        self.hints = [hints.get(p) for p in positional[: len(self.params)]] + [None] * max(0, len(self.params) - len(positional))
        self.output = self._outputs(output, hints.get("return"), many)

    def _outputs(self, output, hint, many: bool) -> dict[str, T.DataType]:
        if isinstance(output, dict):
            return {k: spark_type(v) for k, v in output.items()}
        if output is None:
            output = hint if hint is not None else str
            if many and typing.get_origin(output) is not None and typing.get_origin(output) not in (tuple, typing.Union, dict):
                output = typing.get_args(output)[0]
        kinds = list(output) if isinstance(output, (list, tuple)) else list(typing.get_args(output)) if typing.get_origin(output) is tuple else [output]
        base = self.name or getattr(self.func, "__name__", type(self.func).__name__.lower()).strip("<>")
        names = [base] if len(kinds) == 1 else [f"{base}_{i}" for i in range(len(kinds))]
        return {n: spark_type(k) for n, k in zip(names, kinds)}

    def caller(self):
        """A function of a row's values; runs the setup on first use in a task."""
        func, hints = self.func, self.hints
        if isinstance(func, UDF):
            func.setup()
        extra = {k: v() for k, v in self.setup.items()}
        run = func.process if isinstance(func, UDF) else func
        label = getattr(func, "__name__", type(func).__name__)

        def call(*values, lists=False):
            try:
                if not lists:
                    values = [as_object(v, h) for v, h in zip(values, hints)]
                out = run(*values, **extra)
                return list(out) if inspect.isgenerator(out) else out
            except Exception as e:
                raise UserCodeError(f"error in {label}: {e!r}") from e

        return call

    def close(self):
        if isinstance(self.func, UDF):
            self.func.teardown()

    def row(self, value) -> tuple:
        """One output row's values."""
        n = len(self.output)
        if n == 1:
            return (plain(value[0] if isinstance(value, tuple) and len(value) == 1 else value),)
        if not isinstance(value, tuple) or len(value) != n:
            raise UserCodeError(f"{n} values were declared, the function returned {value!r}")
        return tuple(map(plain, value))

    def arrays(self, rows: list[tuple]) -> list[pa.Array]:
        cols = list(zip(*rows)) if rows else [[] for _ in self.output]
        return [pa.array(_mapped(c, t), to_arrow_type(t)) for c, t in zip(cols, self.output.values())]

    @property
    def fields(self) -> list[T.StructField]:
        return [T.StructField(k, v) for k, v in self.output.items()]


def _mapped(values, kind: T.DataType):
    if isinstance(kind, T.MapType):
        return [None if v is None else list(v.items()) if isinstance(v, dict) else v for v in values]
    if isinstance(kind, T.DoubleType):
        return [float(v) if isinstance(v, int) else v for v in values]
    return list(values)


#: Bytes of Arrow data whose values are Python objects at a time; a batch that Spark sends may have 64 MB.
PIECE = 1 << 20
#: Rows that a generator gives before they leave as a batch.
MANY = 10_000


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to PIECE bytes, or of one row."""
    if batch.num_rows > 1 and batch.nbytes > PIECE:
        half = batch.num_rows // 2
        yield from _pieces(batch.slice(0, half))
        yield from _pieces(batch.slice(half))
    elif batch.num_rows:
        yield batch


def _wide(df: DataFrame, params: list[str]) -> tuple[DataFrame, list[int]]:
    """All columns and the parameters, with the parameters' places; those that are columns themselves aren't sent twice."""
    names, more, places = list(df.columns), [], []
    for p in params:
        own = "." not in p and p in names
        places.append(names.index(p) if own else len(names) + len(more))
        more += [] if own else [F.col(p).alias(f"__p{len(more)}")]
    return df.select(*[F.col(f"`{c}`") for c in names], *more), places


def _values(batch: pa.RecordBatch, places: list[int]) -> Iterator[tuple]:
    return zip(*[batch.column(i).to_pylist() for i in places]) if places else iter([()] * batch.num_rows)


def map_rows(df: DataFrame, plan: Plan) -> DataFrame:
    """Adds the function's columns; only its parameters become Python values, a piece at a time, the rest pass as Arrow."""
    clash = [c for c in plan.output if c.lower() in {x.lower() for x in df.columns}]
    if clash:
        raise ValueError(f"columns {clash} exist already")
    width = len(df.columns)
    wide, places = _wide(df, plan.params)

    def run(batches):
        with closing(plan):
            call = plan.caller()
            for batch in batches:
                for piece in _pieces(batch):
                    rows = [plan.row(call(*v)) for v in _values(piece, places)]
                    yield pa.RecordBatch.from_arrays([*piece.columns[:width], *plan.arrays(rows)], names=[*df_columns, *plan.output])

    df_columns = list(df.columns)
    schema = T.StructType([*df.schema.fields, *plan.fields])
    del df
    return wide.mapInArrow(run, schema)


def generate(df: DataFrame, plan: Plan) -> DataFrame:
    """Rows of the function's results, in place of the input's columns."""
    n = len(plan.params)
    slim = df.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(plan.params)]) if n else df.select(F.lit(1).alias("__p"))

    def run(batches):
        with closing(plan):
            call = plan.caller()
            for batch in batches:
                for piece in _pieces(batch):
                    rows = (plan.row(x) for v in _values(piece, list(range(n))) for x in _many(call(*v)))
                    while part := list(islice(rows, MANY)):
                        yield pa.RecordBatch.from_arrays(plan.arrays(part), names=list(plan.output))

    schema = T.StructType(plan.fields)
    del df
    return slim.mapInArrow(run, schema)


def _many(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, set)) or hasattr(value, "__next__") else [value]


def batch_map(df: DataFrame, plan: Plan, batch: int = 1000) -> DataFrame:
    """As ``map_rows``, the function taking lists of up to ``batch`` values and returning as many results."""
    width = len(df.columns)
    names = list(df.columns)
    wide, places = _wide(df, plan.params)

    def run(batches):
        with closing(plan):
            call = plan.caller()
            for whole in batches:
                for at in range(0, whole.num_rows, batch):
                    part = whole.slice(at, batch)
                    got = list(call(*[part.column(i).to_pylist() for i in places], lists=True))
                    if len(got) != part.num_rows:
                        raise UserCodeError(f"{part.num_rows} results were due, the function returned {len(got)}")
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *plan.arrays([plan.row(x) for x in got])], names=[*names, *plan.output])

    schema = T.StructType([*df.schema.fields, *plan.fields])
    del df
    return wide.mapInArrow(run, schema)


def aggregate(df: DataFrame, plan: Plan, partition_by=None) -> DataFrame:
    """The function on each group's lists of values; without keys all rows are one group."""
    held_df, held, _ = keyed(df, partition_by)
    if not held:
        held_df, held = df.withColumn("__k0", F.lit(1)), ["__k0"]
    n = len(plan.params)
    slim = held_df.select(*held, *[to_column(p).alias(f"__p{i}") for i, p in enumerate(plan.params)])

    def run(table: pa.Table) -> pa.Table:
        with closing(plan):
            call = plan.caller()
            lists = [[as_object(x, _item(h)) for x in table.column(f"__p{i}").to_pylist()] for i, h in zip(range(n), plan.hints)]
            rows = [plan.row(x) for x in _many(call(*lists, lists=True))]
        return pa.table(dict(zip(plan.output, plan.arrays(rows))))

    schema = T.StructType(plan.fields)
    del df, held_df
    return slim.groupBy(*held).applyInArrow(run, schema)


def _item(hint):
    args = typing.get_args(hint)
    return args[0] if args and model_fields(args[0]) is not None else None
