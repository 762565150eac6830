import gzip
import hashlib
import json
import random
from pathlib import Path

import pytest

from weft.llm import warc

SCHEMA = "page_id long, url string, html string, URL2 string, shard int"


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    words = [f"wörd{i}" for i in range(500)]
    rows = [(i, f"http://h{rng.randint(0, 9)}.example/{rng.randint(0, 40)} ä%20\r\n", "<p>" + " ".join(rng.choices(words, k=rng.randint(0, 300))), "x", 1) for i in range(n)]
    rows += [rows[0], rows[0], rows[5], (None, None, None, None, None), (None, None, "", None, None), (7, None, None, "x", 1), (8, "http://x/", None, "x", 1), (8, "http://x/", "", "x", 1), (999, "http://long/", "é" * 3_000_000 + "\r\n\r\nx", "x", 1)]
    return rows


def written(folder):
    return {p.name: p.read_bytes() for p in Path(folder).iterdir()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("warc") / "a"
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(7)
    index = warc.write_warc(df, str(out), roll_bytes=20_000, shard_bytes=2_000_000)
    assert index.columns == ["page_id", "url", "file", "position", "length", "digest"] and index.count() == len(corpus())
    return out, index.collect()


def test_round_trip(spark, folder):
    got = [tuple(r)[:3] for r in warc.read_warc(spark, str(folder[0])).collect()]
    assert sorted(got, key=str) == sorted((r[:3] for r in corpus()), key=str)


def test_same_bytes_whatever_the_partitions(spark, folder, tmp_path):
    rows = corpus()
    random.Random(1).shuffle(rows)
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(2), f"file://{tmp_path}/b", roll_bytes=20_000, shard_bytes=2_000_000)
    assert written(tmp_path / "b") == written(folder[0])


def test_files_are_sorted_rolled_and_valid(folder):
    out, index = folder
    files = written(out)
    manifest = json.loads(files.pop("manifest.json"))
    assert {f["file"]: f["bytes"] for f in manifest["files"]} == {n: len(b) for n, b in files.items()}
    assert len({n[:12] for n in files}) > 1 and len(files) > len({n[:12] for n in files})  # shards; files of a shard
    keys, names = [], set()
    for name in sorted(files):
        rows = sorted((r for r in index if r.file == name), key=lambda r: r.position)
        assert len(files[name]) <= 20_000 or len(rows) == 1
        keys += [warc._order((r.url, r.page_id)) for r in rows]
        for r in rows:
            rec = warc.parse(gzip.decompress(files[name][r.position : r.position + r.length]))
            assert rec["version"] == "WARC/1.1" and rec["warc-payload-digest"] == r.digest
            payload = rec["block"].partition(b"\r\n\r\n")[2]
            assert warc._sha1(payload) == r.digest and warc._sha1(rec["block"]) == rec["warc-block-digest"]
            assert hashlib.sha1(payload).digest()
            names.add(rec["warc-record-id"])
        assert gzip.decompress(files[name]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert keys == sorted(keys) and len(names) == len(index)


def test_leftovers_of_lost_attempts_are_not_named(spark, tmp_path):
    (tmp_path / "c/_temporary").mkdir(parents=True)
    (tmp_path / "c/_temporary/dead-pages-000000-00000.warc.gz").write_bytes(b"half")
    warc.write_warc(spark.createDataFrame(corpus(20), SCHEMA), str(tmp_path / "c"))
    assert sorted(written(tmp_path / "c")) == ["manifest.json", "pages-000000-00000.warc.gz"]
    with pytest.raises(FileExistsError):
        warc.write_warc(spark.createDataFrame(corpus(20), SCHEMA), str(tmp_path / "c"))


def test_empty_table(spark, tmp_path):
    index = warc.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "d"))
    assert index.collect() == [] and warc.read_warc(spark, str(tmp_path / "d")).collect() == []
    assert sorted(written(tmp_path / "d")) == ["manifest.json"]
