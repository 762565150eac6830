"""Members of tar files as rows; a member is read by its offset, the archive isn't unpacked."""

from __future__ import annotations

import json
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import filesystem

MEMBERS = "source string, path string, size long, location string"


def _parts(batch) -> list[tuple[str, str]]:
    return [(s["source"], s["path"]) for s in batch.column(0).to_pylist()]


def process_tar(files: DataFrame, column: str = "file") -> DataFrame:
    """(source, path, size, location) of each regular member; location has the archive, offset and size as JSON."""

    def run(batches):
        for batch in batches:
            rows = []
            for source, path in _parts(batch):
                fs, base = filesystem(source)
                with fs.open_input_file(f"{base}/{path}") as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    rows += [(source, f"{path}/{m.name}", m.size, json.dumps([{"vtype": "tar", "parent": path, "offset": m.offset_data, "size": m.size}])) for m in tar if m.isfile()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["source", "path", "size", "location"])

    return files.select(F.struct(f"{column}.source", f"{column}.path").alias("f")).mapInArrow(run, MEMBERS)


def read_member(source: str, location: str) -> bytes:
    """Bytes of a member."""
    at = json.loads(location)[0]
    fs, base = filesystem(source)
    with fs.open_input_file(f"{base}/{at['parent']}") as f:
        f.seek(at["offset"])
        return f.read(at["size"])


def process_webdataset(files: DataFrame, core: tuple[str, ...] = ("jpg", "png", "jpeg"), column: str = "file") -> DataFrame:
    """(source, stem, core_location, json, txt): members of a tar that share a stem as one row."""
    m = process_tar(files, column)
    stem, ext = F.regexp_extract("path", r"^(.*/[^/.]*|[^/.]*)\.[^/]*$", 1), F.regexp_extract("path", r"^(?:.*/)?[^/.]*\.([^/]*)$", 1)

    @F.pandas_udf("string")
    def text(source, location):
        return source.combine(location, lambda s, x: read_member(s, x).decode("utf-8", "replace"))

    named = m.select("source", stem.alias("stem"), ext.alias("ext"), "location")
    read = named.withColumn("body", F.when(F.col("ext").isin("json", "txt"), text("source", "location")))
    pick = lambda c, v: F.max(F.when(c, F.col(v)))
    return read.groupBy("source", "stem").agg(pick(F.col("ext").isin(*core), "location").alias("core_location"), pick(F.col("ext") == "json", "body").alias("json"), pick(F.col("ext") == "txt", "body").alias("txt"))
