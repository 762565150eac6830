import io
import tarfile

import pytest
from pyspark.sql import types as T

from weft.sources.archives import process_tar, process_webdataset, read_member
from weft import models
from weft.__main__ import main as cli
from weft.files import File, image_info
from weft.sources.listing import check_bucket, find, list_files
from weft.storage import arrow_root
from weft.sources.patterns import expand_braces, pattern_regex, split_pattern
from weft.streaming import read_folder, run_available, windowed_counts


def test_braces_and_patterns():
    assert expand_braces("a{1..3}/{x,y}") == ["a1/x", "a1/y", "a2/x", "a2/y", "a3/x", "a3/y"]
    assert expand_braces("f{08..10}") == ["f08", "f09", "f10"] and expand_braces("{c..a}") == ["c", "b", "a"]
    assert split_pattern("s3://b/x/*.jpg") == ("s3://b/x", "*.jpg") and split_pattern("/a/b/") == ("/a/b", None)
    with pytest.raises(ValueError):
        split_pattern("s3://b*/x")
    assert pattern_regex("**/*.j?g") == r"\A(?:.*/)?[^/]*\.j[^/]g\z"


@pytest.fixture
def tree(tmp_path):
    for p in ("cats/1.jpg", "cats/2.JPG", "dogs/big/3.jpg", "dogs/n.txt", "top.md"):
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_text(p)
    return tmp_path / "tree"


def test_listing(spark, tree):
    paths = lambda uri, **kw: sorted(r.path for r in list_files(spark, uri, **kw).select("file.path").collect())
    assert paths(str(tree)) == ["cats/1.jpg", "cats/2.JPG", "dogs/big/3.jpg", "dogs/n.txt", "top.md"]
    assert paths(f"{tree}/**/*.jpg") == ["cats/1.jpg", "dogs/big/3.jpg"] and paths(f"{tree}/{{cats,dogs}}/*.[jt]*") == ["1.jpg", "n.txt"]
    assert paths(str(tree), kind="image") == ["cats/1.jpg", "cats/2.JPG", "dogs/big/3.jpg"]
    files = list_files(spark, str(tree)).select("file.*")
    assert {r.path for r in find(files, name="*i*", kind="d").collect()} == {"dogs/big"}
    assert {r.path for r in find(files, iname="*.jpg", size=-10).collect()} == {"cats/1.jpg", "cats/2.JPG"}


def test_tar_and_webdataset(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, body in (("d/1.jpg", b"\xff\xd8"), ("d/1.json", b'{"k": 1}'), ("d/1.txt", b"one"), ("d/2.jpg", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    files = list_files(spark, f"{tmp_path}/*.tar")
    got = {r.path: read_member(r.source, r.location) for r in process_tar(files).collect()}
    assert got == {"a.tar/d/1.jpg": b"\xff\xd8", "a.tar/d/1.json": b'{"k": 1}', "a.tar/d/1.txt": b"one", "a.tar/d/2.jpg": b"x"}


def test_webdataset_rows(spark, tmp_path):
    with tarfile.open(tmp_path / "w.tar", "w") as tar:
        for name, body in (("1.jpg", b"j"), ("1.json", b'{"k": 1}'), ("1.txt", b"one"), ("2.jpg", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    rows = {r.stem.rpartition("/")[2]: r for r in process_webdataset(list_files(spark, f"{tmp_path}/*.tar")).collect()}
    assert (rows["1"].json, rows["1"].txt, rows["2"].json) == ('{"k": 1}', "one", None)
    assert read_member(rows["2"].source, rows["2"].core_location) == b"x"


def test_stream_of_new_files(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.TimestampType())])
    write = lambda a, b: spark.range(a, b).selectExpr("id AS k", "timestamp_seconds(id * 1200) AS t").write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    go = lambda: run_available(read_folder(spark, f"{tmp_path}/in", schema), lambda df, i: seen.append(df.count()), f"{tmp_path}/cp")
    write(0, 5)
    go()
    write(5, 8)
    go()
    assert sum(seen) == 8
    counts = windowed_counts(spark.read.schema(schema).parquet(f"{tmp_path}/in"), "t", [])
    assert sorted(r.n for r in counts.collect()) == [2, 3, 3]


def test_addresses_of_stores():
    assert [arrow_root(u) for u in ("/a/b c", "s3a://b/k/%20", "hdfs://n:8020/x", "file:///t#")] == [("", "/a/b c"), ("s3://b/", "k/%20"), ("hdfs://n:8020/", "x"), ("", "/t#")]
    with pytest.raises(ValueError):
        check_bucket("s3://Bad_Bucket!/x")
    check_bucket("s3://good-bucket/x")


def test_file_objects(tmp_path):
    f = File.upload("grün".encode(), f"file://{tmp_path}/a b/x.txt")
    assert (f.name, f.get_file_stem(), f.get_file_ext(), f.size) == ("x.txt", "x", "txt", 5) and f.read_text() == "grün" and f.read(2) == b"gr"
    assert f.as_text_file().read(3) == "grü" and File.at(f.save(f"{tmp_path}/c/y.txt")).etag
    assert f.export(f"{tmp_path}/out", "filename").endswith("out/x.txt") and (tmp_path / "out/x.txt").read_text() == "grün"
    with pytest.raises(FileNotFoundError):
        File(source=str(tmp_path), path="none").ensure()


def test_media_headers(tmp_path):
    import struct
    import wave

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 7, 9)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 3, 5) + b"\0" * 8
    assert [(i.width, i.height, i.format) for i in map(image_info, (png, b"GIF89a" + struct.pack("<HH", 2, 3), jpeg, b"nothing"))] == [(7, 9, "png"), (2, 3, "gif"), (5, 3, "jpeg"), (-1, -1, "")]
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(struct.pack("<250h", *range(250)))
    audio = File.at(f"{tmp_path}/a.wav").as_audio_file()
    info = audio.get_info()
    assert (info.sample_rate, info.channels, info.samples, info.duration) == (100, 1, 250, 2.5)
    assert [(f.start, f.end) for f in audio.get_fragments(1.0)] == [(0.0, 1.0), (1.0, 2.0), (2.0, 2.5)]
    data, rate = audio.to_numpy(1.0, 0.5)
    assert rate == 100 and data.shape == (50, 1) and round(data[0, 0] * 32767) == 100


def test_models():
    box = models.BBox.from_coco([10, 20, 30, 40], "cat")
    assert box.coords == [10, 20, 40, 60] and box.to_coco() == [10, 20, 30, 40] and models.BBox.from_yolo(box.to_yolo((100, 100)), (100, 100)).coords == box.coords
    assert box.point_inside(10, 60) and not box.point_inside(9, 60)
    pose = models.Pose.from_list([[12] * 17, [0] + [30] * 16])
    assert not box.pose_inside(pose) and box.pose_inside(models.Pose.from_dict({"x": [0] + [12] * 16, "y": [0] + [30] * 16}))
    assert models.Segment.from_list([[1.4, 2], [3, 4]]).x == [1, 2] and models.OBBox.from_list(range(8)).coords[-1] == 7
    for bad in (lambda: models.BBox.from_list([1]), lambda: models.Pose.from_list([[1], [2]]), lambda: models.OBBox.from_list([1])):
        with pytest.raises(ValueError):
            bad()


def test_command_line(spark, tree, tmp_path, capsys):
    script = tmp_path / "job.py"
    script.write_text("from weft import metrics, param\nmetrics.set('seen', param('k'))\n")
    assert cli(["query", str(script), "--param", "k=v"]) == 0 and '"seen": "v"' in capsys.readouterr().out
    assert cli(["find", str(tree), "--name", "*.md"]) == 0 and "top.md" in capsys.readouterr().out


def test_listings_are_saved_and_expire(spark, tree):
    count = lambda **kw: list_files(spark, str(tree), **kw).count()
    assert count() == 5
    (tree / "new.md").write_text("x")
    assert count() == 5 and count(update=True) == 6 and count(ttl=-1) == 6
    from weft import listings

    assert str(tree) in listings().to_values("description")


def test_parse_tabular(spark, tmp_path):
    from weft import Chain

    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.csv").write_text("Id,First Name\n1,x\n2,y\n")
    (tmp_path / "t/b.jsonl").write_text('{"first_name": "z", "id": 3}\n')
    got = Chain(list_files(spark, f"{tmp_path}/t")).parse_tabular(source=True)
    assert sorted((r.id, r.first_name, r.source.path) for r in got.df.collect()) == [(1, "x", "a.csv"), (2, "y", "a.csv"), (3, "z", "b.jsonl")]
    assert sorted(Chain(list_files(spark, f"{tmp_path}/t/*.csv")).parse_tabular(output={"k": int, "n": str}, column="row", nrows=1).to_list("row.k", "row.n")) == [(1, "x")]


def test_parse_tabular_types_fit_all_files_and_blocks(spark, tmp_path):
    from weft import Chain

    for folder, files in {
        "late": {"a.csv": "k,n,v,e\n", "b.csv": "k,n,v,e\n1,x,2,\n", "c.csv": "n,v,k,e\ny,2.5,7,\n", "d.csv": ""},
        "blocks": {"a.csv": "k,v,w\n" + "1,,1\n" * 300_000 + '2,"p ""q""\nr",2.5\n'},
    }.items():
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / name).write_text(text)
    late = Chain(list_files(spark, f"{tmp_path}/late/*.csv")).parse_tabular()
    assert late.df.dtypes == [("k", "bigint"), ("n", "string"), ("v", "double"), ("e", "string")]
    assert sorted(late.to_list()) == [(1, "x", 2.0, None), (7, "y", 2.5, None)]
    blocks = Chain(list_files(spark, f"{tmp_path}/blocks/*.csv"))
    assert blocks.parse_tabular().df.groupBy("k", "v", "w").count().orderBy("k").collect() == [(1, "", 1.0, 300_000), (2, 'p "q"\nr', 2.5, 1)]
    assert blocks.parse_tabular(output={"k": str, "v": str, "w": float}).df.where("k = '2'").collect() == [("2", 'p "q"\nr', 2.5)]


def test_tabular_files_with_an_empty_partition(spark, tmp_path):
    """The first part that is written may be a header alone."""
    from weft import queries

    people = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    people.repartition(1).write.option("compression", "none").parquet(f"{tmp_path}/customer.parquet")
    one = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = queries.queries()["tabular_files"](spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", one)
    assert got.dtypes == [(n, "bigint" if t == "int" else t) for n, t in people.dtypes]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, people.collect()))


def test_explode_sees_keys_of_all_rows(spark):
    from weft import Chain

    rows = [(i, '{"a": 1}') for i in range(300)] + [(300, '{"a": 2.5, "late": "x"}')]
    got = Chain(spark.createDataFrame(rows, "i long, j string")).explode("j").df.where("i = 300").first().j_expl
    assert (got.a, got.late) == (2.5, "x")
