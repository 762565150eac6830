import dataclasses
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import weft
from weft import C, Catalog, Chain, read_dataset, read_values
from weft import functions as fn
from weft.operators import udf
from weft.operators.rows import chunk_limit, split_bounds
from weft.plans.incremental import SchemaDriftError


@pytest.fixture
def cat(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/catalog")


def chain(cat=None, **values):
    out = read_values(**values)
    out._catalog = cat
    return out


@dataclasses.dataclass
class Pet:
    name: str
    age: int | None = None


def test_values_types_and_nan(spark):
    c = chain(a=[1, None], b=[float("nan"), 2.5], p=[Pet("x", 1), Pet("y")], t=[["u"], []], n=[None, None])
    assert {k: v.simpleString() for k, v in c.schema.items()} == {"a": "bigint", "b": "double", "p": "struct<name:string,age:bigint>", "t": "array<string>", "n": "string"}
    assert c.filter(C("b").is_(None)).to_values("a") == [1]
    assert str(c.to_list("b")) == "[(nan,), (2.5,)]"
    with pytest.raises(ValueError):
        read_values(a=[1], b=[1, 2])


def test_select_mutate_rename_and_nested(spark):
    c = chain(a=[1, 2], p=[Pet("x", 1), Pet("y", 2)])
    assert c.mutate(b=C("a")).df.columns == ["p", "b"]
    assert c.select("p.name").df.schema.simpleString() == "struct<p:struct<name:string>>"
    assert c.mutate(**{"p.age": C("p.age") * 10}).select("p.age").results() == [(10,), (20,)]
    with pytest.raises(TypeError):
        c.mutate(**{"p.age": "text"})
    for bad in (lambda: c.select("zzz"), lambda: c.select_except("p.name"), lambda: c.mutate(**{"p.new": 1})):
        with pytest.raises(KeyError):
            bad()
    assert c.mutate(a=C("a") + 1, b=C("a")).order_by("a").to_list("a", "b") == [(2, 1), (3, 2)]


def test_order_stacks_and_limits_commute(spark):
    c = chain(a=[2, 1, 2, 1, None], b=[1, 2, 0, 1, 5])
    assert c.order_by("a").order_by("b", descending=True).to_list() == [(None, 5), (1, 2), (1, 1), (2, 1), (2, 0)]
    assert c.order_by("b").limit(3).offset(1).to_values("b") == [1, 1, 2]
    assert c.order_by("b").limit(4).limit(2).to_values("b") == [0, 1]
    assert c.order_by("b").limit(2).filter(C("b") > 0).to_values("b") == [1]
    assert c.count() == 5 and not c.empty and (c.sum("b"), c.min("a"), c.max("b"), c.avg("b")) == (9, 1, 5, 1.8)


def test_merge_names_nulls_and_kinds(spark):
    a, b = chain(id=[1, 2, None], v=["x", "y", "z"]), chain(id=[2, 3, None], v=["p", "q", "r"])
    assert a.merge(b, on="id").order_by("v").to_list() == [(1, "x", None, None), (2, "y", 2, "p"), (None, "z", None, None)]
    assert a.merge(b, on="id").df.columns == ["id", "v", "right_id", "right_v"]
    assert a.merge(b, on="id", inner=True).count() == 1 and a.merge(b, on="id", full=True).count() == 5
    assert a.merge(a, on="id", inner=True).count() == 2
    with pytest.raises(ValueError):
        a.merge(b, on="id", inner=True, full=True)
    with pytest.raises(ValueError):
        a.merge(b, on=["id", "v"], right_on="id")


def test_union_subtract_diff(spark):
    a, b = chain(id=[1, 2, 3, None], v=["a", "b", None, "n"]), chain(id=[2, 3, 4, None], v=["b", "x", "d", "n"])
    assert (a | b).count() == 8
    with pytest.raises(ValueError, match="v only in the left; w only in the right"):
        a.union(b.mutate(w=C("v")))
    assert sorted(a.subtract(b).to_list(), key=str) == [(1, "a"), (3, None)]
    assert {(r[0], r[2]) for r in a.filter(~C("id").isNull()).diff(b.filter(~C("id").isNull()), on="id", same=True, status_col="s").to_list()} == {(1, "A"), (4, "D"), (2, "S"), (3, "S")}
    parts = a.filter(~C("id").isNull()).compare_and_split(b.filter(~C("id").isNull()).mutate(v=fn.case((C("id") == 2, "zz"), else_=F.col("v"))), on="id")
    assert {k: sorted(x.to_values("id")) for k, x in parts.items()} == {"A": [1], "D": [4], "M": [2], "S": [3]}


def test_diff_gives_each_row_once_where_keys_repeat(spark):
    a, b = chain(id=[1, 1, 1, 2, 2, 3, 5, None], v=["a", "b", None, "x", "x", "c", "q", "n"]), chain(id=[1, 1, 1, 2, 2, 4, 4, None, None], v=["a", "z", "z", "x", "x", "d", "d", "n", "m"])
    got = a.diff(b, on="id", same=True, status_col="s")
    assert sorted(got.to_list(), key=str) == sorted([(1, "a", "S"), (1, "b", "M"), (1, None, "S"), (2, "x", "S"), (2, "x", "S"), (3, "c", "A"), (5, "q", "A"), (None, "n", "A"), (4, None, "D"), (4, None, "D"), (None, None, "D"), (None, None, "D")], key=str)
    assert sorted(a.diff(b.mutate(w=F.lit(1)), on="id", added=False, deleted=False, status_col="s").to_values("s")) == ["M"] * 5
    many = chain(id=[7] * 70_000)
    assert chain(id=[1]).diff(many, on="id", added=False).count() == 70_000


def test_file_diff_status_of_pages_with_one_address(spark, tmp_path):
    from weft import queries

    spark.createDataFrame([(1, "u", "short"), (2, "u", "short"), (3, "u", "x" * 3001), (4, "u", "y" * 3001), (5, "w", "z")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, queries.queries()["file_diff_status"](spark, str(tmp_path)).collect())) == [("u", "M"), ("u", "M"), ("u", "S"), ("u", "S"), ("w", "S")]


def test_functions_take_pieces_of_batches_and_each_column_once(spark):
    texts = Chain(spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), F.lit(10_000)).alias("t")))
    wide = texts.map(n=lambda t: len(t), output=int)
    assert "__p0" not in wide.df._jdf.queryExecution().optimizedPlan().toString()
    assert (wide.count(), wide.sum("n"), wide.sum("id"), wide.filter(F.length("t") == 10_000).count()) == (3000, 30_000_000, 3000 * 2999 // 2, 3000)
    many = texts.gen(n=lambda id, t: [id] * 30, output=int)
    assert (many.count(), many.sum("n")) == (90_000, 30 * 3000 * 2999 // 2)
    pets = chain(p=[Pet("x", 1)], n=[1], t=["a"]).df
    wide, places = udf._wide(pets, ["t", "p.name", "n", "t"])
    assert (wide.columns, places) == (["p", "n", "t", "__p0"], [2, 3, 1, 2])
    assert Chain(pets).map(lambda t, name, n: f"{t}{name}{n}", params=["t", "p.name", "n"], output={"z": str}).to_values("z") == ["ax1"]
    batch = pa.record_batch({"i": list(range(5000)), "t": ["y" * 1000] * 4999 + ["z" * 3_000_000]})
    parts = list(udf._pieces(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert len(parts) > 5 and all(x.nbytes <= udf.PIECE or x.num_rows == 1 for x in parts)


def test_group_by_nested_keys(spark):
    c = chain(p=[Pet("x", 1), Pet("x", 2), Pet("y", 3)], n=[1, None, 5])
    g = c.group_by(partition_by="p.name", all=fn.collect("n"), k=fn.count("n"))
    assert g.df.schema.simpleString().startswith("struct<p:struct<name:string>,all:array<bigint>")
    assert g.order_by("p.name").select("all", "k").results() == [([None, 1], 1), ([5], 1)]
    with pytest.raises(ValueError):
        c.group_by(partition_by="n")


def test_functions_with_plain_python(spark):
    assert chain(x=[0, 1, 5, 123456, -7, 2**63 - 1]).mutate(h=fn.int_hash_64("x")).to_values("h") == [int_hash(x) for x in (0, 1, 5, 123456, -7, 2**63 - 1)]
    c = chain(s=["a/b.tar.gz", "", ".bashrc", "x/y/", "/f", None])
    got = c.mutate(p=fn.parent("s"), n=fn.name("s"), t=fn.file_stem("s"), e=fn.file_ext("s")).select("p", "n", "t", "e").results()
    assert got == [("a", "b.tar.gz", "b.tar", "gz"), ("", "", "", ""), ("", ".bashrc", "", "bashrc"), ("x/y", "", "", ""), ("", "f", "f", ""), (None,) * 4]
    c = chain(a=[[1, 2, 3], [], [4]])
    a = fn.array
    assert c.mutate(x=a.slice("a", 1), y=a.slice("a", -2, 1), z=a.get_element("a", -1), w=a.contains("a", 4)).select("x", "y", "z", "w").results() == [([2, 3], [2], 3, 0), ([], [], None, 0), ([], [4], 4, 1)]
    c = chain(a=["karolin", "", "ab"], b=["kathrin", "xyz", "ab"])
    assert c.mutate(d=fn.byte_hamming_distance("a", "b")).to_values("d") == [3, 3, 0]
    assert c.mutate(d=fn.string.split("a", "o", 1), r=fn.string.regexp_replace("b", "(.)t", r"$\1")).select("d", "r").results()[0] == (["kar", "lin"], "k$ahrin")
    assert chain(a=[1, None], b=[3, 4]).mutate(g=fn.greatest("a", "b"), l=fn.least("a", "b")).select("g", "l").results() == [(3, 1), (None, None)]
    assert fn.array._siphash(bytes(range(16)), bytes(range(15))) == 0xA129CA6149BE45E5


def int_hash(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 33)) & m
    x = x * 0xFF51AFD7ED558CCD & m
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & m
    x ^= x >> 33
    return x - (1 << 64) if x >> 63 else x


def test_glob(spark):
    c = chain(s=["a/b.jpg", "A/b.jpg", "a[1].png", "a1.png", "^x", "a.b\\c"])
    for pattern, want in {"*.jpg": [0, 1], "a*": [0, 2, 3, 5], "a[1].png": [3], "[^a]*": [1, 4], "?1.png": [3], "a.b\\c": [5], "A/*": [1]}.items():
        assert c.filter(C("s").glob(pattern)).to_values("s") == [c.to_values("s")[i] for i in want]


def test_python_functions(spark):
    class Twice(weft.Mapper):
        def setup(self):
            self.k = 2

        def process(self, a) -> int:
            return a * self.k

    c = chain(a=[1, 2, 3], g=["x", "y", "x"])
    assert c.map(t=Twice()).order_by("a").to_values("t") == [2, 4, 6]
    assert c.setup(k=lambda: 10).map(lambda a, k: a + k, params="a", output={"z": int}).order_by("a").to_values("z") == [11, 12, 13]

    @dataclasses.dataclass
    class Animal:  # local, so that workers get it by value
        name: str
        age: int

    def pets(a, g):
        yield from (Animal(g, a) for _ in range(a))

    got = c.gen(pets, output={"pet": Animal})
    assert got.count() == 6 and got.df.columns == ["pet"]
    assert got.map(lambda pet: pet["age"] + 1, output={"n": int}).sum("n") == 20

    def total(g, a) -> tuple[str, int]:
        return [(g[0], sum(a))]

    assert sorted(c.agg(total, partition_by="g").to_list()) == [("x", 4), ("y", 2)]
    assert c.agg(lambda a: [len(a)], params="a", output={"n": int}).to_list() == [(3,)]
    with pytest.raises(ValueError):
        c.map(a=lambda g: g)
    with pytest.raises(Exception, match="error in boom"):
        def boom(a) -> int:
            raise RuntimeError("x")

        c.map(boom).to_list()


def test_sys_split_chunk_shuffle_sample(spark):
    c = chain(a=list(range(500))).order_by("a").persist()
    assert c.settings(sys=True).select("sys.id", "a").order_by("a").results()[:2] == [(1, 0), (2, 1)]
    parts = c.train_test_split([0.6, 0.3, 0.1], seed=3)
    ids = [p.to_values("a") for p in parts]
    assert sorted(x for i in ids for x in i) == list(range(500)) and all(ids)
    assert [p.to_values("a") for p in c.train_test_split([0.6, 0.3, 0.1], seed=3)] == ids
    chunks = [c.chunk(i, 3).to_values("a") for i in range(3)]
    assert min(map(len, chunks)) > 120
    assert sorted(x for i in chunks for x in i) == list(range(500))
    assert sum(chunk_limit(10, i, 3) for i in range(3)) == 10 and c.limit(10).chunk(1, 3).count() == 3
    assert c.shuffle().to_values("a") == c.shuffle().to_values("a") != list(range(500))
    assert c.sample(7).count() == 7 and split_bounds([1, 1])[1] == 2**30
    for bad in ([1], [1, -1], [0, 0]):
        with pytest.raises(ValueError):
            c.train_test_split(bad)


def test_sinks_round_trip(spark, tmp_path):
    c = chain(p=[Pet("x, \"q\"", 1), Pet("y\nz", None)], v=[1.5, None])
    c.to_parquet(f"{tmp_path}/p")
    assert weft.read_parquet(f"{tmp_path}/p").order_by("v").results() == c.order_by("v").results()
    c.to_csv(f"{tmp_path}/c")
    back = weft.read_csv(f"{tmp_path}/c")
    assert back.df.columns == ["p_name", "p_age", "v"] and sorted(back.results(), key=str) == sorted(c.results(), key=str)
    c.to_json(f"{tmp_path}/j.json")
    c.to_jsonl(f"{tmp_path}/l")
    for got in (weft.read_json(f"{tmp_path}/j.json"), weft.read_json(f"{tmp_path}/l", format="jsonl")):
        assert sorted(got.select("p.name", "v").results(), key=str) == sorted(c.select("p.name", "v").results(), key=str)
    db = f"{tmp_path}/d.db"
    assert c.to_database("t", db, conflict_columns=["p__name"]) == 2
    assert c.to_database("t", db, on_conflict="ignore", conflict_columns=["p__name"]) == 0
    assert c.mutate(v=9.0).to_database("t", db, on_conflict="update", conflict_columns=["p__name"]) == 2
    assert weft.read_database("SELECT v, p__name FROM t ORDER BY 2", db).to_list() == [(9.0, 'x, "q"'), (9.0, "y\nz")]
    with pytest.raises(sqlite3.IntegrityError):
        c.to_database("t", db)
    assert c.to_records()[0].keys() == {"p__name", "p__age", "v"} and list(c.to_pandas(flatten=False).columns)[0] == ("p", "name")


def test_versions_specifiers_and_lineage(spark, cat):
    a = chain(cat, id=[1, 2]).save("a", attrs=["kind=x", "y"])
    assert (a.dataset, a.version) == ("local.local.a", "1.0.0")
    assert chain(cat, id=[1]).save("a", update_version="minor").version == "1.1.0"
    assert chain(cat, id=[5, 6, 7]).save("a", update_version="major").version == "2.0.0"
    read = lambda v=None: read_dataset(spark, "a", v, catalog=cat)
    assert [read(v).count() for v in (None, 1, "1.0.0", ">=1,<2", "<1.1")] == [3, 1, 2, 1, 2]
    with pytest.raises(KeyError):
        read("9.0.0")
    with pytest.raises(ValueError):
        chain(cat, id=[1]).save("a", version="0.1.0")
    read(1).filter(C("id") > 0).save("b")
    read_dataset(spark, "b", catalog=cat).save("ns.pr.c")
    assert [d["name"] for d in cat.dependencies("ns.pr.c", recursive=True)] == ["local.local.b", "local.local.a"]
    assert cat.datasets(attrs=["kind"]).count() == 1 and cat.datasets().count() == 5
    cat.move("b", "b2")
    assert read_dataset(spark, "b2", catalog=cat).count() == 1
    cat.delete("a")
    assert cat.versions("a") == ["1.0.0", "1.1.0"]
    cat.delete("a", force=True)
    with pytest.raises(KeyError):
        read()
    with pytest.raises(ValueError):
        cat.delete_namespace("ns")


def test_delta_retry_and_checkpoint(spark, cat):
    def run(**kw):
        def check(v) -> str:
            return "bad" if v < 0 else ""

        return read_dataset(spark, "src", catalog=cat, delta=True, delta_on="id", **kw).map(error=check).save("res")

    chain(cat, id=[1, 2, 3], v=[1, -1, 1]).save("src")
    first = run()
    assert first.version == "1.0.0" and run().version == "1.0.0"
    chain(cat, id=[1, 2, 3, 4], v=[1, -1, 7, 1]).save("src")
    second = run()
    assert second.version == "1.0.1" and sorted(second.to_list()) == [(1, 1, ""), (2, -1, "bad"), (3, 7, ""), (4, 1, "")]
    assert run(delta_retry="error").version == "1.0.2"
    with pytest.raises(NotImplementedError):
        read_dataset(spark, "src", catalog=cat, delta=True, delta_on="id").distinct("id")
    chain(cat, id=[9], v=[1]).save("src")
    with pytest.raises(SchemaDriftError):
        read_dataset(spark, "src", catalog=cat, delta=True, delta_on="id").mutate(other=1).save("res")
    job = lambda: read_dataset(spark, "src", "1.0.0", catalog=cat).filter(C("id") > 1).save("once", checkpoint="job1")
    assert job().version == job().version == "1.0.0"


def test_chain_is_lazy_about_the_explode_schema(spark):
    c = chain(j=['{"a": 1, "b": {"c": "x"}}', None, '{"a": 2}'])
    assert c.explode("j").select("j_expl.a", "j_expl.b.c").results() == [(1, "x"), (None, None), (2, None)]
    assert isinstance(c.apply(lambda x: x.clone()), Chain)
