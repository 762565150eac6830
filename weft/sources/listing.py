"""Files under addresses as rows, and what file trees are asked: ls, find, du."""

from __future__ import annotations

import hashlib
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import glob_regex
from ..functions.path import file_ext, parent
from ..functions.path import name as name_of
from ..plans.catalog import Catalog
from .patterns import expand_braces, needs_recursion, pattern_regex, split_pattern

TTL = 4 * 3600
KINDS = {"image": ["jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff"], "text": ["txt", "md", "csv", "json", "jsonl", "xml", "html"], "video": ["mp4", "mov", "avi", "mkv", "webm"], "audio": ["mp3", "wav", "flac", "ogg", "m4a"]}


def _list(spark: SparkSession, base: str, recursive: bool) -> DataFrame:
    """One row a file, without reading any: Spark lists folders, in parallel where there are many."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(base)
    full = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/+", "/")
    root = re.sub("^file:/+", "/", base).rstrip("/")
    return raw.select(
        F.lit("file://" + root if "://" not in root else root).alias("source"), F.substring(full, len(root) + 2, 1 << 30).alias("path"), F.col("length").alias("size"), F.lit("").alias("version"),
        F.md5(F.concat_ws(":", full, F.col("length").cast("string"), F.col("modificationTime").cast("string"))).alias("etag"), F.lit(True).alias("is_latest"), F.col("modificationTime").alias("last_modified"), F.lit(None).cast("string").alias("location"),
    )


def listing_name(base: str, recursive: bool) -> str:
    return f"lst__{hashlib.sha256(f'{base}|{recursive}'.encode()).hexdigest()[:24]}"


def check_bucket(uri: str) -> None:
    """A ValueError for a bucket's name that no store takes."""
    scheme, found, rest = uri.partition("://")
    bucket = rest.partition("/")[0]
    if found and scheme.lower() in ("s3", "s3a", "gs", "gcs") and not re.fullmatch(r"[a-z0-9][a-z0-9._-]{1,61}[a-z0-9]", bucket):
        raise ValueError(f"{bucket!r} is no bucket's name")


def get_listing(spark: SparkSession, base: str, recursive: bool = True, update: bool = False, ttl: int = TTL) -> DataFrame:
    """The files below an address as a saved dataset: its newest version until that expires, then a new one."""
    check_bucket(base)
    catalog, name = Catalog(spark), listing_name(base, recursive)
    have = catalog.versions(name)
    if update or not have or time.time() - catalog.manifest(name)["created_at"] > ttl:
        catalog.save(_list(spark, base, recursive), name, description=base)
    return catalog.read(name)


def read_listing_dataset(spark: SparkSession, name: str, version: str | None = None, path: str = "") -> DataFrame:
    """The files of a saved listing, or those below a folder of it."""
    files = Catalog(spark).read(name, version)
    base = path.strip("/")
    return files.where((F.col("path") == base) | F.col("path").startswith(base + "/")) if base else files


def node(files: DataFrame, path: str) -> DataFrame:
    """(path, is_dir, size) of a file, or of a folder that has files below it; no row if there is neither."""
    base = path.strip("/")
    inside = files.where((F.col("path") == base) | F.col("path").startswith(base + "/")) if base else files
    both = inside.agg(F.max(F.col("path") == base).alias("is_file"), F.sum("size").alias("size")).where("size is not null")
    return both.select(F.lit(base).alias("path"), (~F.coalesce("is_file", F.lit(False))).alias("is_dir"), "size")


def subtree(files: DataFrame, path: str = "") -> DataFrame:
    """All files below a folder."""
    return ls(files, path, recursive=True)


def list_files(spark: SparkSession, uri: str | list[str], kind: str | None = None, recursive: bool = True, column: str = "file", update: bool = False, ttl: int = TTL) -> DataFrame:
    """Rows of files under the addresses, braces and globs expanded. A listing is used again until it expires."""
    parts = []
    for one in dict.fromkeys(x for u in ([uri] if isinstance(uri, str) else uri) for x in expand_braces(u)):
        base, pattern = split_pattern(one)
        files = get_listing(spark, base, recursive and (pattern is None or needs_recursion(pattern)), update, ttl)
        parts.append(files.where(F.col("path").rlike(pattern_regex(pattern))) if pattern else files)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if kind:
        out = out.where(F.lower(file_ext("path")).isin(KINDS[kind]))
    return out.select(F.struct("*").alias(column))


def directories(paths: DataFrame, column: str = "path") -> DataFrame:
    """All folders above the paths, once each: prefixes are exploded, nothing recurs."""
    parts = F.split(F.col(column), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return paths.where(F.instr(F.col(column), "/") > 0).select(F.explode(prefixes).alias("path")).where("path <> ''").distinct()


def ls(files: DataFrame, path: str = "", recursive: bool = False) -> DataFrame:
    """(path, name, is_dir, size): files below a folder, or its direct children with folders among them."""
    base = path.strip("/")
    inside = files.where(F.col("path").startswith(base + "/")) if base else files
    if recursive:
        return inside.select("path", name_of("path").alias("name"), F.lit(False).alias("is_dir"), "size")
    rest = F.substring("path", len(base) + 2 if base else 1, 1 << 30)
    child = F.substring_index(rest, "/", 1)
    full = F.concat(F.lit(base + "/"), child) if base else child
    return inside.groupBy(full.alias("path"), child.alias("name"), (F.instr(rest, "/") > 0).alias("is_dir")).agg(F.sum("size").alias("size"))


def du(files: DataFrame, depth: int = 0) -> DataFrame:
    """(path, size, n_files) of folders down to a depth; the root's path is empty."""
    parts = F.split(parent("path"), "/")
    levels = F.least(F.lit(depth), F.when(parent("path") == "", 0).otherwise(F.size(parts)))
    prefixes = F.transform(F.sequence(F.lit(0), levels), lambda k: F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")))
    return files.select(F.explode(prefixes).alias("path"), "size").groupBy("path").agg(F.sum("size").alias("size"), F.count("*").alias("n_files"))


def _any(column: Column, globs) -> Column:
    out = F.lit(False)
    for g in [globs] if isinstance(globs, str) else globs:
        out = out | column.rlike(glob_regex(g))
    return out


def find(files: DataFrame, name=None, iname=None, path=None, ipath=None, size: int | None = None, kind: str | None = None) -> DataFrame:
    """Files, and folders with size 0, that meet all conditions; ``size``: at least n, or at most -n. kind: 'f' or 'd'."""
    all_ = files.select("path", F.lit("f").alias("kind"), "size").unionByName(directories(files).select("path", F.lit("d").alias("kind"), F.lit(0).cast("long").alias("size")))
    if name:
        all_ = all_.where(_any(name_of("path"), name))
    if iname:
        all_ = all_.where(_any(F.lower(name_of("path")), [g.lower() for g in ([iname] if isinstance(iname, str) else iname)]))
    if path:
        all_ = all_.where(_any(F.col("path"), path))
    if ipath:
        all_ = all_.where(_any(F.lower("path"), [g.lower() for g in ([ipath] if isinstance(ipath, str) else ipath)]))
    if size is not None:
        all_ = all_.where(F.col("size") >= size if size >= 0 else F.col("size") <= -size)
    return all_ if kind is None else all_.where(F.col("kind") == kind)
