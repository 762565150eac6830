"""One query for each operator on the driver's tables, and its SQL; both over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .chain import Chain, read_dataset
from .columns import C
from .files import File
from .operators.rows import split_conditions
from .operators.udf import Aggregator, BatchMapper, Generator, Mapper
from .params import metrics, param, set_params
from .plans.catalog import Catalog
from .sources import readers
from .sources.archives import process_tar
from .sources.listing import directories, du, find, list_files, listing_name, ls, node, read_listing_dataset, subtree
from .storage import new_path, shared_dir

_QUERIES: dict = {}
_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: Chain(spark.read.parquet(f"{sf_dir}/{name}.parquet")))
            return out._visible() if isinstance(out, Chain) else out

        run.__name__ = f.__name__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n, min(l_tax) AS min_tax, max(l_tax) AS max_tax FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(t):
    c = t("lineitem").filter(C("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).mutate(price=C("l_extendedprice") * (1 - C("l_discount")))
    return c.group_by(partition_by=["l_returnflag", "l_linestatus"], sum_qty=fn.sum("l_quantity"), revenue=F.round(fn.sum("price"), 2), avg_disc=F.round(fn.avg("l_discount"), 6), n=fn.count(), min_tax=fn.min("l_tax"), max_tax=fn.max("l_tax"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def select_cols(t):
    return t("orders").select("o_orderkey", "o_totalprice")


@query("SELECT * EXCLUDE (props) FROM events")
def select_except(t):
    return t("events").select_except("props")


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND NOT (p_size < 10 OR p_size > 40)")
def filter_in_or_not(t):
    return t("part").filter(C("p_brand").in_(["Brand#11", "Brand#12", "Brand#23"]), ~((C("p_size") < 10) | (C("p_size") > 40))).select("p_partkey", "p_brand", "p_type")


@query("SELECT page_id, url FROM pages WHERE url GLOB '*example.com/*'")
def filter_glob(t):
    return t("pages").filter(C("url").glob("*example.com/*")).select("page_id", "url")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]{2}')")
def filter_regexp(t):
    return t("part").filter(C("p_name").regexp("[aeiou]{2}")).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS charge, l_quantity / 2 AS half, 'x' AS tag, l_returnflag AS flag FROM lineitem")
def mutate_arith_rename(t):
    c = t("lineitem").mutate(charge=F.round(C("l_extendedprice") * (1 - C("l_discount")) * (1 + C("l_tax")), 7), half=C("l_quantity") / 2, tag="x", flag=C("l_returnflag"))
    return c.select("l_orderkey", "l_linenumber", "charge", "half", "tag", "flag")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t):
    return t("orders").order_by("o_totalprice", descending=True).order_by("o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10")
def offset_limit(t):
    return t("customer").order_by("c_custkey").limit(20).offset(10).select("c_custkey", "c_name")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_keys(t):
    return t("orders").distinct("o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority")


@query("SELECT c_custkey AS k, c_name AS n FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(t):
    return t("customer").mutate(k=C("c_custkey"), n=C("c_name")).select("k", "n") | t("supplier").mutate(n=C("s_name"), k=C("s_suppkey")).select("n", "k")


@query("SELECT count(*) AS n, round(sum(value), 2) AS total, count(props) AS n_props FROM events")
def global_aggregate(t):
    return t("events").group_by(n=fn.count(), total=F.round(fn.sum("value"), 2), n_props=fn.count("props"))


@query("SELECT user_id, list(event_type ORDER BY event_type) AS types, string_agg(event_type, '|' ORDER BY event_type) AS joined FROM events GROUP BY user_id")
def collect_concat(t):
    return t("events").group_by(partition_by="user_id", types=fn.collect("event_type"), joined=fn.concat("event_type", "|"))


@query("SELECT regexp_extract(url, '^[a-z]+') AS scheme, count(*) AS n FROM pages GROUP BY ALL")
def group_by_func_key(t):
    return t("pages").group_by(partition_by=fn.string.split("url", ":", 1)[0].alias("scheme"), n=fn.count())


@query("SELECT n_regionkey, any_value(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def any_value(t):
    return t("nation").merge(t("region"), on="n_regionkey", right_on="r_regionkey", inner=True).group_by(partition_by="n_regionkey", region=fn.any_value("r_name"))


@query("SELECT o_custkey, sum(o_orderkey) * (5 - min(o_orderkey)) AS mixed FROM orders GROUP BY ALL".replace("sum(o_orderkey)", "sum(o_orderkey)::BIGINT"))
def aggregate_arithmetic(t):
    return t("orders").group_by(partition_by="o_custkey", mixed=fn.sum("o_orderkey") * (5 - fn.min("o_orderkey")))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 10")
def having(t):
    return t("orders").group_by(partition_by="o_orderstatus", n=fn.count()).filter(C("n") > 10)


@query("SELECT o_orderkey, c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def merge_left(t):
    return t("orders").merge(t("customer"), on="o_custkey", right_on="c_custkey").select("o_orderkey", "c_custkey", "c_name")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def merge_inner(t):
    return t("documents").merge(t("labels"), on="doc_id", inner=True).select("doc_id", "quality", "toxic")


@query("SELECT s_suppkey, n_nationkey, n_name FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey")
def merge_full(t):
    return t("supplier").merge(t("nation"), on="s_nationkey", right_on="n_nationkey", full=True).select("s_suppkey", "n_nationkey", "n_name")


@query("SELECT a.n_nationkey, b.n_nationkey AS right_n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_merge(t):
    n = t("nation")
    return n.merge(n, on="n_regionkey", inner=True).select("n_nationkey", "right_n_nationkey")


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_quantity % 7 = o_custkey % 7")
def merge_multi_expression(t):
    return t("lineitem").merge(t("orders"), on=["l_orderkey", F.col("l_quantity").cast("long") % 7], right_on=["o_orderkey", C("o_custkey") % 7], inner=True).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_acctbal > n_nationkey * 400 AND s_nationkey <> n_nationkey")
def theta_join(t):
    return t("supplier").join(t("nation"), lambda a, b: (a("s_acctbal") > b("n_nationkey") * 400) & (a("s_nationkey") != b("n_nationkey")), inner=True).select("s_suppkey", "n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def subtract_keys(t):
    return t("orders").subtract(t("lineitem").filter(C("l_quantity") > 40), on="o_orderkey", right_on="l_orderkey").select("o_orderkey")


_NULLED = "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang FROM documents"


@query(f"SELECT * FROM ({_NULLED}) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, CASE WHEN source LIKE '%e%' THEN lang ELSE 'other' END AS lang FROM ({_NULLED.replace('lang FROM', 'lang, source FROM')})) b WHERE a.doc_id = b.doc_id AND a.lang IS NOT DISTINCT FROM b.lang)")
def subtract_null_safe(t):
    a = t("documents").mutate(lang=F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).select("doc_id", "lang", "source")
    return a.select("doc_id", "lang").subtract(a.mutate(lang=fn.case((F.col("source").like("%e%"), F.col("lang")), else_="other")).select("doc_id", "lang"))


_MOVED = "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey + 1000000000 ELSE o_orderkey END"


@query(f"""WITH l AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s FROM orders), r AS (SELECT {_MOVED} AS o_orderkey, o_custkey, CASE WHEN o_totalprice > 200000 THEN 'Z' ELSE o_orderstatus END AS s FROM orders)
SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, l.o_custkey, l.s, CASE WHEN r.o_orderkey IS NULL THEN 'A' WHEN l.o_orderkey IS NULL THEN 'D' WHEN l.o_custkey <> r.o_custkey OR l.s <> r.s THEN 'M' ELSE 'S' END AS status FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey""")
def diff_status(t):
    """Two whole tables: in the second some keys and some statuses differ."""
    left = t("orders").mutate(s=C("o_orderstatus")).select("o_orderkey", "o_custkey", "s")
    right = t("orders").mutate(o_orderkey=F.expr(_MOVED), s=fn.case((C("o_totalprice") > 200000, "Z"), else_=F.col("o_orderstatus"))).select("o_orderkey", "o_custkey", "s")
    return left.diff(right, on="o_orderkey", same=True, status_col="status")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events")
def window_row_number(t):
    return t("events").mutate(rn=fn.over(fn.row_number(), fn.window("user_id", "event_id"))).select("event_id", "rn")


@query("SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS d, first_value(event_type) OVER (PARTITION BY event_type ORDER BY value DESC) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type DESC)")
def window_ranks(t):
    w = fn.window("user_id", "event_type", desc=True)
    return t("events").mutate(r=fn.over(fn.rank(), w), d=fn.over(fn.dense_rank(), w), f=fn.over(fn.first("event_type"), fn.window("event_type", "value", desc=True))).select("event_id", "r", "d", "f")


@query(r"SELECT p_partkey, length(p_name) AS n, string_split(p_name, ' ') AS parts, replace(p_name, 'a', '__') AS rep, regexp_replace(p_name, '(\w)(\w+)', '\2\1', 'g') AS turned FROM part")
def string_functions(t):
    s = fn.string
    return t("part").mutate(n=s.length("p_name"), parts=s.split("p_name", " "), rep=s.replace("p_name", "a", "__"), turned=s.regexp_replace("p_name", r"(\w)(\w+)", r"\2\1")).select("p_partkey", "n", "parts", "rep", "turned")


@query("SELECT p_partkey, (hamming(left(p_name, n), left(p_type, n)) + abs(length(p_name) - length(p_type)))::BIGINT AS d FROM (SELECT *, least(length(p_name), length(p_type)) AS n FROM part)")
def byte_hamming(t):
    return t("part").mutate(d=fn.byte_hamming_distance("p_name", "p_type")).select("p_partkey", "d")


@query(r"""SELECT page_id, regexp_replace(url, '/+[^/]*$', '') AS parent, regexp_extract(url, '[^/]*$') AS name, regexp_replace(regexp_extract(url, '[^/]*$'), '\.+[^.]*$', '') AS stem,
CASE WHEN contains(regexp_extract(url, '[^/]*$'), '.') THEN regexp_extract(url, '[^./]*$') ELSE '' END AS ext FROM pages""")
def path_functions(t):
    return t("pages").mutate(parent=fn.parent("url"), name=fn.name("url"), stem=fn.file_stem("url"), ext=fn.file_ext("url")).select("page_id", "parent", "name", "stem", "ext")


@query("SELECT vec_id, len(embedding) AS n, list_contains(embedding, embedding[1])::INT AS has, embedding[3:5] AS part, embedding[2] AS second, embedding[-1] AS last FROM embeddings")
def array_functions(t):
    a = fn.array
    return t("embeddings").mutate(n=a.length("embedding"), has=a.contains("embedding", F.get("embedding", F.lit(0))), part=a.slice("embedding", 2, 3), second=a.get_element("embedding", 1), last=a.get_element("embedding", -1)).select("vec_id", "n", "has", "part", "second", "last")


@query("SELECT doc_id, array_to_string(string_split(text, ' '), '-') AS joined FROM documents")
def array_join(t):
    return t("documents").mutate(joined=fn.array.join(fn.string.split("text", " "), "-")).select("doc_id", "joined")


_V = "[0.1 * (i % 7) - 0.3 for i in range(64)]"


@query(f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {_V.replace('64', '0, 64')}::DOUBLE[]), 6) AS cos, round(list_distance(embedding::DOUBLE[], {_V.replace('64', '0, 64')}::DOUBLE[]), 6) AS l2 FROM embeddings")
def vector_distances(t):
    v = [0.1 * (i % 7) - 0.3 for i in range(64)]
    return t("embeddings").mutate(cos=F.round(fn.cosine_distance("embedding", v), 6), l2=F.round(fn.euclidean_distance("embedding", v), 6)).select("vec_id", "cos", "l2")


#: SipHash-2-4 under a zero key of the text and a zero byte, computed apart from this package.
SIP = {"click": -3054302176019437786, "error": -3401841900663455940, "purchase": 3678534911748787947, "signup": -1005345997687501127, "view": -6251928034203017922}


@query("SELECT event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN ({v})::BIGINT" for k, v in SIP.items()) + " END AS h FROM events")
def sip_hash(t):
    return t("events").mutate(h=fn.sip_hash_64(F.array("event_type"))).select("event_id", "h")


@query("SELECT l_orderkey, l_linenumber, l_orderkey & l_partkey AS a, l_orderkey | l_partkey AS o, xor(l_orderkey, l_partkey) AS x, bit_count(xor(l_orderkey, l_partkey))::BIGINT AS h, l_partkey << 3 AS sl, l_partkey >> 2 AS sr, l_partkey // 7 AS fd, l_partkey % 7 AS m FROM lineitem")
def bit_functions(t):
    a, b = "l_orderkey", "l_partkey"
    return t("lineitem").mutate(a=fn.bit_and(a, b), o=fn.bit_or(a, b), x=fn.bit_xor(a, b), h=fn.bit_hamming_distance(a, b), sl=fn.shift_left(b, 3), sr=fn.shift_right(b, 2), fd=fn.floor_divide(b, F.lit(7)), m=C(b) % 7).select("l_orderkey", "l_linenumber", "a", "o", "x", "h", "sl", "sr", "fd", "m")


_W = "18446744073709551616::HUGEINT"


def _mul(x: str, k: int) -> str:
    low, high = k & 0xFFFFFFFF, k >> 32
    return f"((({x})::HUGEINT * {low} + ((({x})::HUGEINT * {high}) % 4294967296) * 4294967296) % {_W})"


@query(
    f"""WITH a AS (SELECT o_orderkey, xor(o_orderkey, o_orderkey >> 33)::HUGEINT AS x FROM orders), b AS (SELECT o_orderkey, {_mul("x", 0xFF51AFD7ED558CCD)}::UBIGINT AS x FROM a), c AS (SELECT o_orderkey, xor(x, x >> 33)::HUGEINT AS x FROM b),
d AS (SELECT o_orderkey, {_mul("x", 0xC4CEB9FE1A85EC53)}::UBIGINT AS x FROM c), e AS (SELECT o_orderkey, xor(x, x >> 33)::HUGEINT AS x FROM d) SELECT o_orderkey, (CASE WHEN x >= 9223372036854775808::HUGEINT THEN x - {_W} ELSE x END)::BIGINT AS h FROM e"""
)
def int_hash(t):
    return t("orders").mutate(h=fn.int_hash_64("o_orderkey")).select("o_orderkey", "h")


@query("""SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN NULL ELSE greatest(c_acctbal, 100.0::DOUBLE) END AS g, least(c_acctbal, 100.0::DOUBLE) AS l, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band,
CASE WHEN c_nationkey > 10 THEN 1 ELSE 0 END AS hi, c_mktsegment IS NULL AS none, (c_nationkey = 1 OR c_nationkey = 2) AS o, (c_nationkey > 1 AND c_acctbal > 0) AS a, NOT (c_nationkey = 3) AS n FROM customer""")
def conditional_functions(t):
    c = t("customer").mutate(
        g=fn.greatest("c_acctbal", F.lit(100.0)), l=fn.least("c_acctbal", F.lit(100.0)), band=fn.case((C("c_acctbal") < 0, "debt"), (C("c_acctbal") < 1000, "low"), else_="high"), hi=fn.ifelse(C("c_nationkey") > 10, 1, 0),
        none=fn.isnone("c_mktsegment"), o=fn.or_(C("c_nationkey") == 1, C("c_nationkey") == 2), a=fn.and_(C("c_nationkey") > 1, C("c_acctbal") > 0), n=fn.not_(C("c_nationkey") == 3),
    )
    return c.select("c_custkey", "g", "l", "band", "hi", "none", "o", "a", "n")


@query()
def random_function(t):
    return t("customer").mutate(r=fn.rand()).select("c_custkey", "r")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def explode_props(t):
    return t("events").explode("props").select("event_id", "props_expl.k").mutate(k=C("props_expl.k")).select("event_id", "k")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS capitals FROM documents")
def map_udf(t):
    def capitals(text) -> int:
        return sum("A" <= c <= "Z" for c in text)

    return t("documents").map(capitals=capitals).select("doc_id", "capitals")


@query("SELECT doc_id AS line_0, unnest(string_split(text, chr(10))) AS line_1 FROM documents")
def gen_udf(t):
    def line(doc_id, text) -> tuple[int, str]:
        for x in text.split("\n"):
            yield doc_id, x

    return t("documents").gen(line)


@query("SELECT conv_id AS talk_0, count(*) AS talk_1, string_agg(role, '>' ORDER BY turn) AS talk_2 FROM conversations GROUP BY conv_id")
def agg_udf(t):
    def talk(conv_id, turn, role) -> tuple[int, int, str]:
        yield conv_id[0], len(turn), ">".join(r for _, r in sorted(zip(turn, role)))

    return t("conversations").agg(talk, partition_by="conv_id")


@query("SELECT event_id, value * 2 AS twice FROM events")
def batch_map_udf(t):
    def twice(value) -> float:
        return [v * 2 for v in value]

    return t("events").batch_map(twice=twice, batch=500).select("event_id", "twice")


@query("SELECT o_orderkey, 'v' || o_orderstatus AS tagged FROM orders")
def setup_udf(t):
    def tagged(o_orderstatus, prefix) -> str:
        return prefix + o_orderstatus

    return t("orders").setup(prefix=lambda: "v").map(tagged=tagged).select("o_orderkey", "tagged")


_RAND = "(o_orderkey * 1103515245 + 12345)"


@query(f"SELECT o_orderkey, CASE WHEN {_RAND} % 2147483647 < round(0.7 * 2147483647) THEN 'train' ELSE 'test' END AS part FROM orders")
def train_test_split(t):
    base = t("orders").mutate(r=C("o_orderkey") * 1103515245 + 12345)
    train, test = (base.filter(c) for c in split_conditions(F.col("r"), [0.7, 0.3]))
    return (train.mutate(part="train") | test.mutate(part="test")).select("o_orderkey", "part")


@query("SELECT c_custkey FROM customer")
def chunk_union(t):
    base = t("customer").order_by("c_custkey").persist()
    return (base.chunk(0, 3) | base.chunk(1, 3) | base.chunk(2, 3)).select("c_custkey")


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_custkey FROM customer")
def sys_ids(t):
    return t("customer").order_by("c_custkey").persist().mutate(id=C("sys.id")).select("id", "c_custkey")


@query()
def sample_rows(t):
    return t("orders").sample(100, seed=1)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def save_read(t):
    c = t("orders").select("o_orderkey", "o_orderstatus")
    cat = Catalog(c.spark, f"{shared_dir(c.spark)}/weft-q-{uuid.uuid4().hex}")
    c._catalog = cat
    return c.save("orders")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS s FROM orders")
def delta_equals_full(t):
    """Saved from a part of the orders, then brought up to date when the rest came and some changed."""
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus").mutate(s=C("o_orderstatus"))
    cat = o._catalog = Catalog(o.spark, f"{shared_dir(o.spark)}/weft-q-{uuid.uuid4().hex}")
    run = lambda: read_dataset(o.spark, "src", catalog=cat, delta=True, delta_on="o_orderkey").mutate(twice=C("o_totalprice") * 2).select("o_orderkey", "twice", "s").save("res")
    o.filter(C("o_orderstatus") != "F").save("src")
    run()
    o.mutate(s=fn.case((C("o_orderkey") % 5 == 0, "new"), else_=F.col("s"))).save("src")
    return run()


_URLS = "(SELECT substr(url, strpos(url, '://') + 3) AS path, length(html)::BIGINT AS size FROM pages)"


def _urls(t) -> DataFrame:
    return t("pages").mutate(path=F.expr("substr(url, instr(url, '://') + 3)"), size=F.length("html").cast("long")).select("path", "size").df


@query(f"SELECT DISTINCT array_to_string(p[1:k], '/') AS path FROM (SELECT string_split(path, '/') AS p FROM {_URLS}), LATERAL (SELECT unnest(range(1, len(p))) AS k)")
def tree_directories(t):
    return directories(_urls(t))


@query(f"SELECT split_part(path, '/', 1) AS path, split_part(path, '/', 1) AS name, contains(path, '/') AS is_dir, sum(size)::BIGINT AS size FROM {_URLS} GROUP BY ALL")
def tree_ls(t):
    return ls(_urls(t))


@query(f"SELECT split_part(path, '/', 1) AS path, sum(size)::BIGINT AS size, count(*) AS n_files FROM {_URLS} WHERE contains(path, '/') GROUP BY 1 UNION ALL SELECT '', sum(size)::BIGINT, count(*) FROM {_URLS}")
def tree_du(t):
    return du(_urls(t), 1)


@query(f"SELECT path, 'f' AS kind, size FROM {_URLS} WHERE path GLOB '*/fr/*' AND size >= 2000")
def tree_find(t):
    return find(_urls(t), path="*/fr/*", size=2000, kind="f")


# -- sources and sinks: written to the shared folder and read again -------------------------------------------


def _path(c: Chain, label: str) -> str:
    return new_path(c.spark, label)


_PEOPLE = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(_PEOPLE)
def csv_round_trip(t):
    c = t("customer")
    c.to_csv(path := _path(c, "csv"))
    return Chain(readers.read_csv(c.spark, path))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_typed_columns(t):
    """Without inference: types given, a delimiter of its own."""
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    c.to_csv(path := _path(c, "csv"), delimiter="|")
    return Chain(readers.read_csv(c.spark, path, delimiter="|", output={"c_custkey": int, "c_name": str, "c_acctbal": float}))


@query(_PEOPLE)
def json_lines_round_trip(t):
    c = t("customer")
    c.to_jsonl(path := _path(c, "jsonl"))
    return Chain(readers.read_json(c.spark, path, format="jsonl")).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_array_round_trip(t):
    c = t("nation").select("n_nationkey", "n_name")
    c.to_json(path := _path(c, "json") + ".json")
    return Chain(readers.read_json(c.spark, path, output={"n_nationkey": int, "n_name": str}))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def parquet_partitions_round_trip(t):
    c = t("part").select("p_partkey", "p_name", "p_brand")
    c.to_parquet(path := _path(c, "parquet"), partition_cols=["p_brand"])
    return Chain(readers.read_parquet(c.spark, path)).select("p_partkey", "p_name", "p_brand")


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier")
def database_round_trip(t):
    """Inserted, then some rows updated by their key, then read by a query."""
    import sqlite3

    c = t("supplier").select("s_suppkey", "s_name", "s_acctbal")
    db = sqlite3.connect(":memory:")
    c.to_database("supplier", db, conflict_columns=["s_suppkey"])
    c.filter(C("s_acctbal") > 0).mutate(s_acctbal=C("s_acctbal") + 1).to_database("supplier", db, on_conflict="update", conflict_columns=["s_suppkey"])
    return Chain(readers.read_database(c.spark, "SELECT s_suppkey, s_name, s_acctbal FROM supplier", db))


@query("SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation UNION ALL SELECT -1, 'none' UNION ALL SELECT -2, NULL")
def values_and_records(t):
    spark = t("nation").spark
    new = Chain(readers.read_values(spark, k=[-1], n=["none"])) | Chain(readers.read_records(spark, [{"k": -2}], {"k": int, "n": str}))
    return t("nation").mutate(k=F.col("n_nationkey").cast("long"), n=C("n_name")).select("k", "n") | new


@query("SELECT r_regionkey, r_name FROM region")
def pandas_round_trip(t):
    return Chain(readers.read_pandas(t("region").spark, t("region").to_pandas()))


@query("SELECT s_suppkey AS k, s_name AS n FROM supplier")
def records_round_trip(t):
    c = t("supplier").mutate(k=C("s_suppkey"), n=C("s_name")).select("k", "n")
    return Chain(readers.read_records(c.spark, c.to_records(), {"k": int, "n": str}))


@query("SELECT s_suppkey AS k, s_name AS n FROM supplier")
def columnar_round_trip(t):
    c = t("supplier").mutate(k=C("s_suppkey"), n=C("s_name")).select("k", "n")
    names, chunks = c.to_columnar_data_with_names(100)
    rows = [r for chunk in chunks for r in zip(*chunk)]
    return Chain(c.spark.createDataFrame(rows, "k long, n string")) if names == ["k", "n"] else None


@query("SELECT count(*) AS n, sum(o_custkey)::BIGINT AS s, round(avg(o_totalprice), 4) AS a, min(o_orderkey) AS lo, max(o_orderkey) AS hi, false AS none, count(*) AS first FROM orders")
def terminal_scalars(t):
    o = t("orders")
    row = (o.count(), o.sum("o_custkey"), round(o.avg("o_totalprice"), 4), o.min("o_orderkey"), o.max("o_orderkey"), o.empty, o.group_by(n=fn.count()).as_scalar())
    return Chain(o.spark.createDataFrame([row], "n long, s long, a double, lo long, hi long, none boolean, first long"))


@query("SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def lists_of_values(t):
    n = t("nation").order_by("n_nationkey")
    rows = list(zip(n.to_values("n_name"), [r for (r,) in n.to_list("n_regionkey")]))
    return Chain(readers.read_values(n.spark, name=[a for a, _ in rows], region=[b for _, b in rows]))


# -- files that the query writes itself ------------------------------------------------------------------------


def _folder(t) -> tuple[Chain, str]:
    """A folder of text files: nations by region, each in a file of its own name."""
    n = t("nation").merge(t("region"), on="n_regionkey", right_on="r_regionkey", inner=True)
    root = _path(n, "tree")
    for region, name in n.to_iter("r_name", "n_name"):
        File.upload(name.encode(), f"{root}/{region}/{name}.txt")
    return n, root


_TREE = "SELECT r_name || '/' || n_name || '.txt' AS path, length(n_name)::BIGINT AS size, n_name AS body FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT path, size, body FROM ({_TREE})")
def files_read_by_functions(t):
    n, root = _folder(t)

    def body(file: File) -> str:
        return file.read_text()

    c = Chain(list_files(n.spark, root)).map(body=body)
    return c.mutate(path=C("file.path"), size=C("file.size")).select("path", "size", "body")


@query(f"SELECT split_part(path, '/', 2) AS name FROM ({_TREE}) WHERE path GLOB 'A*/*' OR path GLOB 'EUROPE/*'")
def storage_braces_and_globs(t):
    n, root = _folder(t)
    files = list_files(n.spark, root + "/{A*,EUROPE}/*.txt")
    return Chain(files).mutate(name=fn.name("file.path")).select("name")


@query(f"SELECT path, size FROM ({_TREE}) WHERE path LIKE 'ASIA/%'")
def listing_dataset(t):
    n, root = _folder(t)
    list_files(n.spark, root)
    return Chain(read_listing_dataset(n.spark, listing_name(root, True), path="ASIA").select("path", "size"))


@query(f"SELECT path, false AS is_dir, size FROM ({_TREE}) WHERE path LIKE 'AFRICA/%'")
def tree_subtree(t):
    n, root = _folder(t)
    return Chain(subtree(list_files(n.spark, root).select("file.*"), "AFRICA").select("path", "is_dir", "size"))


@query(f"SELECT 'ASIA' AS path, true AS is_dir, sum(size)::BIGINT AS size FROM ({_TREE}) WHERE path LIKE 'ASIA/%'")
def tree_node(t):
    n, root = _folder(t)
    return Chain(node(list_files(n.spark, root).select("file.*"), "ASIA"))


@query(f"SELECT split_part(path, '/', 2) AS path, size FROM ({_TREE})")
def storage_export(t):
    """Copied by file name to another folder, which is then listed."""
    n, root = _folder(t)
    Chain(list_files(n.spark, root)).to_storage(out := _path(n, "export"), placement="filename")
    return Chain(list_files(n.spark, out)).mutate(path=C("file.path"), size=C("file.size")).select("path", "size")


@query(f"SELECT path, body FROM ({_TREE})")
def tar_members(t):
    import io
    import tarfile

    n, root = _folder(t)
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as tar:
        for path in Chain(list_files(n.spark, root)).to_values("file.path"):
            body = File.at(f"{root}/{path}").read()
            info = tarfile.TarInfo(path)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    File.upload(data.getvalue(), (home := _path(n, "tar")) + "/a.tar")
    members = process_tar(list_files(n.spark, home))

    def body(source, path, size, location) -> str:
        return File(path=path, source=source, size=size, location=location).read_text()

    return Chain(members).map(body=body).mutate(path=F.regexp_replace("path", "^a.tar/", "")).select("path", "body")


@query(_PEOPLE)
def tabular_files(t):
    c = t("customer")
    c.to_csv(path := _path(c, "csv"))
    return Chain(list_files(c.spark, path + "/*.csv")).parse_tabular()


# -- datasets, differences, functions ----------------------------------------------------------------------------


def _own(c: Chain) -> Catalog:
    c._catalog = Catalog(c.spark, new_path(c.spark, "q"))
    return c._catalog


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'A' WHEN o_totalprice > 200000 AND o_orderstatus <> 'Z' THEN 'M' ELSE 'S' END AS status FROM orders UNION ALL SELECT o_orderkey + 1000000000, 'D' FROM orders WHERE o_orderpriority = '1-URGENT'")
def compare_split(t):
    left = t("orders").mutate(s=C("o_orderstatus")).select("o_orderkey", "s")
    right = t("orders").mutate(o_orderkey=F.expr(_MOVED), s=fn.case((C("o_totalprice") > 200000, "Z"), else_=F.col("o_orderstatus"))).select("o_orderkey", "s")
    parts = [c.mutate(status=k).select("o_orderkey", "status") for k, c in left.compare_and_split(right, on="o_orderkey").items()]
    return parts[0] | parts[1] | parts[2] | parts[3]


@query("SELECT url AS path, CASE WHEN length(html) > 3000 THEN 'M' ELSE 'S' END AS status FROM pages")
def file_diff_status(t):
    file = lambda etag: F.struct(F.lit("s3://b").alias("source"), F.col("url").alias("path"), F.lit("").alias("version"), etag.alias("etag"))
    a = t("pages").mutate(file=file(F.md5("html"))).select("file")
    b = t("pages").mutate(file=file(F.when(F.length("html") > 3000, "old").otherwise(F.md5("html")))).select("file")
    return a.file_diff(b, same=True, status_col="status").mutate(path=C("file.path")).select("path", "status")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'tried again' ELSE c_name END AS result, '' AS error FROM customer")
def retry_failed_rows(t):
    """Rows whose error column is set are processed again by the second run, the others are not."""
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    cat = _own(c)
    c.save("src")
    run = lambda bad, good, error: read_dataset(c.spark, "src", catalog=cat, delta=True, delta_on="c_custkey", delta_retry="error").mutate(result=fn.case((C("c_acctbal") < 0, bad), else_=good), error=fn.case((C("c_acctbal") < 0, error), else_="")).select("c_custkey", "result", "error").save("res")
    run("none", F.col("c_name"), "debt")
    return run("tried again", "changed", "")


@query("SELECT * FROM (VALUES ('local', 'a', '1.0.1', 5), ('local', 'moved', '1.0.0', 25)) v(project, name, version, num_rows)")
def dataset_lifecycle(t):
    """Saved, saved again, moved, deleted; what the registry then says."""
    r, n = t("region"), t("nation")
    cat = n._catalog = _own(r)
    r.save("a")
    r.save("a")
    n.save("b")
    cat.move("b", "moved")
    cat.delete("a", "1.0.0")
    return Chain(cat.datasets().select("project", "name", "version", F.col("num_rows").cast("int").alias("num_rows")))


@query("SELECT * FROM (VALUES ('>=1.0,<1.1', '1.0.1'), ('1', '1.1.0'), ('', '2.0.0'), ('==1.1.0', '1.1.0')) v(asked, got)")
def version_lookup(t):
    r = t("region")
    cat = _own(r)
    for update in ("patch", "patch", "minor", "major"):
        r.save("a", update_version=update)
    return Chain(r.spark.createDataFrame([(asked, cat.resolve("a", asked or None)[1]) for asked in (">=1.0,<1.1", "1", "", "==1.1.0")], "asked string, got string"))


@query("SELECT * FROM (VALUES ('local.local.src', '1.0.0')) v(name, version)")
def dataset_dependencies(t):
    r = t("region")
    cat = _own(r)
    r.save("src")
    read_dataset(r.spark, "src", catalog=cat).select("r_name").save("res")
    return Chain(r.spark.createDataFrame([(d["name"], d["version"]) for d in cat.dependencies("res")], "name string, version string"))


@query("SELECT * FROM (VALUES ('1.0.0', true)) v(version, equal)")
def checkpoint_reuse(t):
    r = t("region")
    cat = _own(r)
    r.save("src")
    chain = lambda: read_dataset(r.spark, "src", catalog=cat).filter(C("r_regionkey") > 1)
    chain().save("res", checkpoint="job")
    again = chain().save("res", checkpoint="job")
    return Chain(r.spark.createDataFrame([(again.version, chain().hash() == chain().hash())], "version string, equal boolean"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def split_parts_together(t):
    train, test = t("orders").select("o_orderkey", "o_orderstatus").train_test_split([0.7, 0.3], seed=5)
    return train | test


@query("SELECT o_orderkey FROM orders")
def shuffled(t):
    return t("orders").select("o_orderkey").shuffle()


@query("SELECT * FROM (VALUES (4, 3, 3)) v(a, b, c)")
def chunk_limits(t):
    c = t("customer").limit(10)
    return Chain(c.spark.createDataFrame([tuple(c.chunk(i, 3).count() for i in range(3))], "a int, b int, c int"))


@query("SELECT n_name, n_regionkey * 2 AS twice FROM nation")
def cloned_settings_applied(t):
    double = lambda c, by: c.mutate(twice=C("n_regionkey") * by)
    return t("nation").clone().settings(parallel=2, prefetch=0).apply(double, 2).reset_settings().select("n_name", "twice")


class _Lengths(Mapper):
    def process(self, c_name) -> int:
        return len(c_name)


@query("SELECT c_custkey, length(c_name) AS n FROM customer")
def class_mapper(t):
    return t("customer").map(n=_Lengths()).select("c_custkey", "n")


class _Letters(Generator):
    def process(self, r_name) -> tuple[str, str]:
        for x in r_name:
            yield r_name, x


@query("SELECT r_name AS letters_0, unnest(string_split(r_name, '')) AS letters_1 FROM region")
def class_generator(t):
    return t("region").gen(letters=_Letters())


class _Spread(Aggregator):
    def process(self, n_regionkey, n_nationkey) -> tuple[int, int]:
        yield n_regionkey[0], max(n_nationkey) - min(n_nationkey)


@query("SELECT n_regionkey::BIGINT AS spread_0, (max(n_nationkey) - min(n_nationkey))::BIGINT AS spread_1 FROM nation GROUP BY n_regionkey")
def class_aggregator(t):
    return t("nation").agg(spread=_Spread(), partition_by="n_regionkey")


class _Upper(BatchMapper):
    def process(self, s_name) -> str:
        return [x.upper() for x in s_name]


@query("SELECT s_suppkey, upper(s_name) AS u FROM supplier")
def class_batch_mapper(t):
    return t("supplier").batch_map(u=_Upper()).select("s_suppkey", "u")


@query("SELECT p_partkey, p_size // 7 AS d, xor(p_size, 5) AS x, p_partkey << 3 AS l, p_partkey >> 2 AS r, 9007199254740993 // 3 AS big FROM part")
def column_operators(t):
    p = t("part").mutate(d=(C("p_size") // 7).cast("int"), x=C("p_size") ^ 5, l=C("p_partkey") << 3, r=C("p_partkey") >> 2, big=fn.floor_divide(F.lit(9007199254740993), F.lit(3)))
    return p.select("p_partkey", "d", "x", "l", "r", "big")


@query("SELECT r_regionkey, 'x' AS lit, r_regionkey + 1 AS next FROM region")
def literals_and_labels(t):
    return t("region").df.select("r_regionkey", fn.literal("x").alias("lit"), (C("r_regionkey") + 1).alias("next"))


@query("SELECT p_partkey, [p_size * 1.0::DOUBLE, p_size * 2.0::DOUBLE, p_size * 2.0::DOUBLE, p_size * 3.0::DOUBLE] AS coco, [p_size * 2.0::DOUBLE / 640, p_size * 3.5::DOUBLE / 480, p_size * 2.0::DOUBLE / 640, p_size * 3.0::DOUBLE / 480] AS yolo, p_size BETWEEN 10 AND 25 AS hit FROM part")
def box_conversions(t):
    corners = F.array(*[F.col("p_size") * k for k in (1.0, 2.0, 3.0, 5.0)])
    p = t("part").mutate(voc=corners)
    return p.mutate(coco=fn.boxes.convert("voc", "voc", "coco", 640, 480), yolo=fn.boxes.convert("voc", "voc", "yolo", 640, 480), hit=fn.boxes.contains_point("voc", F.lit(30.0), F.lit(50.0))).select("p_partkey", "coco", "yolo", "hit")


@query("SELECT r_name, 7 AS given FROM region")
def job_parameters(t):
    set_params({"given": "7"})
    metrics.set("regions", t("region").count())
    return t("region").mutate(given=int(param("given"))).select("r_name", "given") if metrics.get("regions") == 5 else None


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
