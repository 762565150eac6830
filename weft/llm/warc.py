"""WARC files by a deterministic sharded writer.

Every page becomes a ``response`` record whose headers, lengths and SHA-1 digests are regenerated, and a gzip member
of its own, made where the page is scanned, so that the shuffle carries compressed bytes. Records are range-sorted by
(url, page_id, digest): the splitters are quantiles, by bytes, of keys that a hash of the key selects, so shards depend
on the rows alone, not on partitions, tasks or attempts. A shard's task writes its members in order and rolls to the next
file before one would pass ``roll_bytes`` compressed; each file starts with a ``warcinfo`` record.

Files are written under temporary names, one set for each attempt of a task. The index of the attempts that count is
committed through Spark; only what it names is renamed to its final name, and the manifest, renamed into place last,
is what makes the folder a WARC collection: readers read what the manifest names and nothing else. A lost executor
costs an attempt, whose files are never named. The same rows give the same bytes in the same files.

Defined results: a null url is written as ``urn:weft:null`` and a null page as an empty body, both marked in a header
so that they read back as null; characters a header can't hold are percent-encoded in the record and restored on
reading; rows that repeat another in full get record identifiers that count them; nulls sort first; an empty table
gives a manifest without files. Other columns aren't written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, filesystem, scratch, stored

ROLL_BYTES, SHARD_BYTES, SAMPLES, LEVEL = 1 << 27, 1 << 28, 64, 6
DATE, NULL_URI = "1970-01-01T00:00:00Z", "urn:weft:null"
INDEX = "page_id long, url string, file string, position long, length long, digest string, temp string"
_SPACE = uuid.UUID("5c0a1d5e-8a63-5f0e-9d3b-0c7e6f1a2b44")
_UNSAFE = re.compile(r"[\x00-\x20%\x7f-￿\U00010000-\U0010ffff]")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzipped(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member without a time or a name, so that equal records have equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _head(lines: list[str]) -> bytes:
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, page: str | None, date: str = DATE, copy: int = 0) -> tuple[bytes, str]:
    """A response record, not yet compressed, and its payload's digest."""
    body = (page or "").encode("utf-8", "surrogatepass")
    digest = _sha1(body)
    block = _head(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]) + body
    uri = NULL_URI if url is None else _UNSAFE.sub(lambda m: quote(m.group(), safe=""), url)
    name = uuid.uuid5(_SPACE, json.dumps([page_id, url, digest, page is None, copy]))
    nulls = [n for n, v in (("page_id", page_id), ("url", url), ("html", page)) if v is None]
    lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}"]
    lines += [f"X-Page-ID: {page_id}"] * (page_id is not None) + [f"X-Null: {' '.join(nulls)}"] * bool(nulls)
    return _head([*lines, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]) + block + b"\r\n\r\n", digest


def warcinfo(file: str, date: str = DATE) -> bytes:
    block = b"software: weft\r\nformat: WARC File Format 1.1\r\n"
    return _head(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, file)}>", f"WARC-Date: {date}", f"WARC-Filename: {file}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]) + block + b"\r\n\r\n"


def _members(date: str, level: int, keys: list[tuple]):
    """(page_id, url, html) to (shard, page_id, url, digest, void, member): a shard is the number of splitters not above
    the key; void: the page is null, not empty."""
    cuts = [_order(k) for k in keys]

    def run(batches):
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            digests, voids, members = [], [], []
            for i, u, h in zip(ids, urls, batch.column(2)):
                page = h.as_py()
                raw, digest = record(i, u, page, date)
                digests.append(digest)
                voids.append(page is None)
                members.append(gzipped(raw, level))
            shards = [bisect_right(cuts, _order(k)) for k in zip(urls, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(voids, pa.bool_()), pa.array(members, pa.binary())], names=["shard", "page_id", "url", "digest", "void", "member"])

    return run


@dataclass(frozen=True)
class _Target:
    folder: str
    roll_bytes: int
    date: str
    level: int


class _File:
    """A WARC file being written under a temporary name."""

    def __init__(self, fs, base: str, attempt: str, name: str, target: _Target):
        self.name, self.temp, self.size, self.rows = name, f"_temporary/{attempt}-{name}", 0, []
        self.out = fs.open_output_stream(f"{base}/{self.temp}", compression=None)
        self.write(gzipped(warcinfo(name, target.date), target.level))

    def write(self, member: bytes) -> int:
        self.out.write(member)
        self.size += len(member)
        return self.size - len(member)


def _write(target: _Target):
    """Sorted rows of whole shards to files; yields the index of each file once it is closed."""

    def again(member: bytes, page_id, url, void: bool, copy: int) -> bytes:
        block = zlib.decompress(member, 31).split(b"\r\n\r\n", 2)[2]
        return gzipped(record(page_id, url, None if void else block[:-4].decode("utf-8", "surrogatepass"), target.date, copy)[0], target.level)

    def index(f: _File):
        f.out.close()
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*f.rows), kinds)], names=["page_id", "url", "file", "position", "length", "digest", "temp"])

    def run(batches):
        fs, base = filesystem(target.folder)
        attempt, file, shard_now, part, last, copy = uuid.uuid4().hex, None, None, 0, None, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for shard, page_id, url, digest, void, member in zip(*columns, batch.column(5)):
                member, key = member.as_py(), (shard, page_id, url, digest, void)
                copy, last = (copy + 1 if key == last else 0), key
                if copy:
                    member = again(member, page_id, url, void, copy)
                if file and (shard != shard_now or file.size + len(member) > target.roll_bytes and file.rows):
                    yield index(file)
                    part, file = (part + 1 if shard == shard_now else 0), None
                if not file:
                    shard_now = shard
                    file = _File(fs, base, attempt, f"pages-{shard:06d}-{part:05d}.warc.gz", target)
                file.rows.append((page_id, url, file.name, file.write(member), len(member), digest, file.temp))
        if file:
            yield index(file)

    return run


def _order(k: tuple) -> tuple:
    """Sorts (url, page_id) as Spark does: by the bytes of the url, nulls first."""
    return k[0] is not None, (k[0] or "").encode(), k[1] is not None, k[1] or 0


def _splitters(pages: DataFrame, shard_bytes: int, samples: int) -> list[tuple]:
    """Quantiles by bytes of the keys that their own hash selects, about ``samples`` for each shard; a function of the rows."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + F.lit(400)
    total = pages.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    shards = -(-int(total.bytes or 0) // shard_bytes)
    if shards < 2:
        return []
    share = min(1.0, samples * shards / total.n)
    hashed = F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    got = sorted((((r.url, r.page_id), r.bytes) for r in pages.where(hashed).groupBy("url", "page_id").agg(F.sum(size).alias("bytes")).collect()), key=lambda x: _order(x[0]))
    ends, below = [], 0
    for _, n in got:
        below += n
        ends.append(below)
    cuts = sorted({bisect_right(ends, below * j / shards) for j in range(1, shards)})
    return [got[c][0] for c in cuts if 0 < c < len(got)]


def write_warc(df: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE, level: int = LEVEL, page_id: str = "page_id", url: str = "url", page: str = "html", samples: int = SAMPLES) -> DataFrame:
    """Writes the pages as WARC files under ``folder`` and returns the index: (page_id, url, file, position, length, digest).

    ``shard_bytes`` is uncompressed bytes of a shard, about; a folder that has a manifest isn't written again.
    """
    spark = df.sparkSession
    fs, base = filesystem(folder)
    if fs.get_file_info(f"{base}/manifest.json").is_file:
        raise FileExistsError(f"{folder} already holds a committed collection")
    fs.create_dir(f"{base}/_temporary", recursive=True)
    pages = df.select(col(page_id).cast("long").alias("page_id"), col(url).alias("url"), col(page).alias("html"))
    keys = _splitters(pages, shard_bytes, samples)
    members = pages.mapInArrow(_members(date, level, keys), "shard int, page_id long, url string, digest string, void boolean, member binary")
    placed = members.repartitionById(len(keys) + 1, F.col("shard"))
    ordered = placed.sortWithinPartitions("shard", "url", "page_id", "digest", "void")
    index = stored(ordered.mapInArrow(_write(_Target(folder, roll_bytes, date, level)), INDEX), "warc-index")
    _commit(index, folder)
    return index.drop("temp")


def _commit(index: DataFrame, folder: str) -> None:
    """Final names for the files of the attempts that count, then the manifest. Repeating it changes nothing."""
    fs, base = filesystem(folder)
    files = index.groupBy("file", "temp").agg(F.count("*").alias("records"), F.max(F.col("position") + F.col("length")).alias("bytes")).orderBy("file").collect()

    def final(r):
        if fs.get_file_info(f"{base}/{r.temp}").is_file:
            fs.move(f"{base}/{r.temp}", f"{base}/{r.file}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(final, files))
    manifest = {"format": "WARC/1.1", "files": [{"file": r.file, "records": r.records, "bytes": r.bytes} for r in files]}
    with fs.open_output_stream(f"{base}/_temporary/manifest.json") as out:
        out.write(json.dumps(manifest, indent=1).encode())
    fs.move(f"{base}/_temporary/manifest.json", f"{base}/manifest.json")
    fs.delete_dir(f"{base}/_temporary")


def parse(raw: bytes) -> dict[str, str | bytes]:
    """Headers, by lower-case name, and 'block' of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out: dict = {"version": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return out | {"block": rest[: int(out["content-length"])]}


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html, file, position) of every response record of a committed collection, a file to a task at least."""
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        names = [(x["file"],) for x in json.loads(f.read())["files"]]

    def run(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for at, raw in _each_member(f):
                        r = parse(raw)
                        if r["warc-type"] != "response":
                            continue
                        if _sha1(r["block"]) != r["warc-block-digest"]:
                            raise ValueError(f"{name} at {at}: the block doesn't match its digest")
                        null, page = r.get("x-null", "").split(), r["block"].partition(b"\r\n\r\n")[2].decode("utf-8", "surrogatepass")
                        rows.append((int(r["x-page-id"]) if "x-page-id" in r else None, None if "url" in null else unquote(r["warc-target-uri"]), None if "html" in null else page, name, at))
                        held += len(raw)
                        if held > 16 << 20:
                            yield _pages(rows)
                            rows, held = [], 0
                yield _pages(rows)

    files = spark.createDataFrame(names, "file string").repartition(max(1, len(names)))
    return files.mapInArrow(run, "page_id long, url string, html string, file string, position long")


def _pages(rows):
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["page_id", "url", "html", "file", "position"])


def _each_member(f, chunk: int = 1 << 20):
    """(offset, bytes) of each gzip member of a stream."""
    held, at, offset = b"", zlib.decompressobj(31), 0
    out, used = [], 0
    while True:
        data = held or f.read(chunk)
        held = b""
        if not data:
            return
        out.append(at.decompress(data))
        used += len(data) - len(at.unused_data)
        if at.eof:
            yield offset, b"".join(out)
            held, offset = at.unused_data, offset + used
            at, out, used = zlib.decompressobj(31), [], 0


def to_shared_folder(df: DataFrame, **kw) -> DataFrame:
    """``write_warc`` to a new folder below the shared one; the index."""
    return write_warc(df, scratch(df.sparkSession, "warc"), **kw)

