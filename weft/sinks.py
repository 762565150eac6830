"""Writers."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import flat, leaves, nested
from .storage import filesystem


def to_parquet(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """Struct leaves become dotted columns; partition columns become folders."""
    writer = flat(df).write.mode("overwrite")
    (writer.partitionBy(*[partition_cols] if isinstance(partition_cols, str) else partition_cols) if partition_cols else writer).parquet(path)


def to_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """A folder of files with a header of dotted names; nested values as JSON."""
    simple = flat(df)
    encoded = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in simple.schema]
    simple.select(*encoded).write.mode("overwrite").csv(path, header=True, sep=delimiter, quote='"', escape='"', emptyValue='""')


def to_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def to_json(df: DataFrame, path: str) -> None:
    """One JSON array in one file, streamed a partition at a time."""
    fs, at = filesystem(path)
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    with fs.open_output_stream(at, compression=None) as out:
        out.write(b"[")
        for i, row in enumerate(lines.toLocalIterator()):
            out.write(b",\n"[not i :] + row.j.encode())
        out.write(b"]")


_SQLITE = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def to_database(df: DataFrame, table: str, connection: str | sqlite3.Connection, batch_size: int = 10_000, on_conflict: str | None = None, conflict_columns: list[str] | None = None, column_mapping: dict[str, str | None] | None = None) -> int:
    """Inserts into a SQLite table, created if need be, in one transaction; returns the rows changed.

    SQLite has one writer, so rows stream to the driver a partition at a time; other databases take ``df.write.jdbc``.
    """
    if on_conflict not in (None, "ignore", "update"):
        raise ValueError("on_conflict is 'ignore' or 'update'")
    names = {n: n.replace(".", "__") for n, _ in leaves(df.schema)} | (column_mapping or {})
    kinds = [(n, names[n], t) for n, t in leaves(df.schema) if names[n]]
    value = lambda n, t: F.to_json(F.col(n)) if isinstance(t, (T.ArrayType, T.MapType)) else F.col(n).cast("string") if t.simpleString() not in _SQLITE else F.col(n)
    rows = df.select(*[value(n, t).alias(new) for n, new, t in kinds])
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    own = not isinstance(connection, sqlite3.Connection)
    db = sqlite3.connect(connection.removeprefix("sqlite:///")) if own else connection
    existed = db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()
    before = db.total_changes
    try:
        unique = f", UNIQUE ({', '.join(map(quote, conflict_columns))})" if conflict_columns else ""
        db.execute(f"CREATE TABLE IF NOT EXISTS {quote(table)} ({', '.join(f'{quote(new)} {_SQLITE.get(t.simpleString(), "TEXT")}' for _, new, t in kinds)}{unique})")
        verb = "INSERT OR IGNORE" if on_conflict == "ignore" else "INSERT"
        sql = f"{verb} INTO {quote(table)} ({', '.join(quote(new) for _, new, _ in kinds)}) VALUES ({', '.join('?' * len(kinds))})"
        if on_conflict == "update":
            if not conflict_columns:
                raise ValueError("conflict_columns are needed to update")
            rest = [new for _, new, _ in kinds if new not in conflict_columns]
            sql += f" ON CONFLICT ({', '.join(map(quote, conflict_columns))}) DO " + ("UPDATE SET " + ", ".join(f"{quote(c)} = excluded.{quote(c)}" for c in rest) if rest else "NOTHING")
        for part in _batches(rows.toLocalIterator(), batch_size):
            db.executemany(sql, part)
        db.commit()
        return db.total_changes - before
    except Exception:
        db.rollback()
        if not existed:
            db.execute(f"DROP TABLE IF EXISTS {quote(table)}")
            db.commit()
        raise
    finally:
        if own:
            db.close()


def _batches(rows: Iterator, n: int) -> Iterator[list[tuple]]:
    part: list[tuple] = []
    for r in rows:
        part.append(tuple(r))
        if len(part) >= n:
            yield part
            part = []
    if part:
        yield part


def destination(output: str, source: str, path: str, etag: str, placement: str) -> str:
    """Where an exported file goes."""
    if placement == "fullpath":
        return f"{output.rstrip('/')}/{source.split('://')[-1].strip('/')}/{path}"
    if placement == "filename":
        return f"{output}/{path.rsplit('/', 1)[-1]}"
    if placement == "filepath":
        return f"{output}/{path}"
    if placement == "etag":
        return f"{output}/{etag}{Path(path).suffix}"
    raise NotImplementedError(f"placement {placement!r}")


def to_storage(df: DataFrame, output: str, signal: str = "file", placement: str = "fullpath", link_type: str = "copy", num_threads: int = 8) -> int:
    """Copies the files that a column names to ``output``, from and to any store, or links them on a local disk; tasks do
    it, each with a few threads. Repeating it, as a retried task does, changes nothing."""
    files = df.select(*[F.col(f"{signal}.{c}").alias(c) for c in ("source", "path", "etag")])
    if placement == "filename" and not files.groupBy(F.substring_index("path", "/", -1)).count().where("count > 1").isEmpty():
        raise ValueError("file names repeat; choose another placement")

    def copy(r) -> None:
        place = destination(output, r.source or "", r.path, r.etag or "", placement)
        if link_type == "symlink":  # local disks only
            to = Path(place.removeprefix("file://"))
            to.parent.mkdir(parents=True, exist_ok=True)
            to.unlink(missing_ok=True)
            to.symlink_to(Path((r.source or "").removeprefix("file://")) / r.path)
            return
        (source, start), (target, end) = filesystem(f"{r.source.rstrip('/')}/{r.path}" if r.source else r.path), filesystem(place)
        target.create_dir(end.rpartition("/")[0], recursive=True)
        with source.open_input_stream(start, compression=None) as f, target.open_output_stream(end, compression=None) as out:
            while piece := f.read(8 << 20):
                out.write(piece)

    def run(rows) -> None:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(num_threads) as pool:
            list(pool.map(copy, rows))

    files.foreachPartition(run)
    return files.count()


def renested(df: DataFrame) -> DataFrame:
    """Dotted columns as structs again."""
    return df.select(*nested(df.columns, lambda n: F.col(f"`{n}`")))


def records(df: DataFrame) -> list[dict]:
    return [json.loads(r.j) for r in flat(df, "__").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
