import random
import re

import numpy as np
import pytest

from weft.llm import html_extract as h

SCHEMA = "page_id long, url string, html string, host int, TEXT string"


def host_of(url):
    m = re.match(h._HOST, url or "")
    return m.group(1).lower() if m else ""


def brute(rows, k):
    """A real suffix array over each host's concatenated tokens, by sorting; repeats from neighbours' common prefixes."""
    out = []
    hosts = {host_of(r[1]) for r in rows}
    for host in hosts:
        stream, page_of, start = [], [], []
        pages = [(i, h.visible_tokens(r[2])) for i, r in enumerate(rows) if host_of(r[1]) == host]
        for i, tokens in pages:
            start.append(len(stream))
            stream += [*tokens, f"\0{i}"]
            page_of += [i] * (len(tokens) + 1)
        order = sorted(range(len(stream)), key=lambda a: stream[a : a + k])
        gone = set()
        groups = {}
        for a in order:
            window = tuple(stream[a : a + k])
            if len(window) == k and not any(t.startswith("\0") for t in window):
                groups.setdefault(window, []).append(a)
        for at in groups.values():
            if len({page_of[a] for a in at}) > 1:
                gone.update(x for a in at for x in range(a, a + k))
        for (i, tokens), s in zip(pages, start):
            runs, run = [], []
            for j, t in enumerate([*tokens, None]):
                if t is not None and s + j not in gone:
                    run.append(t)
                elif run:
                    runs.append(" ".join(run))
                    run = []
            removed = sum(s + j in gone for j in range(len(tokens)))
            out.append((rows[i][0], host, len(tokens), removed, "\n".join(runs)))
    return sorted(out, key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    nav = {u: " ".join(rng.choices(words, k=12)) for u in "abc"}
    rows = []
    for i in range(60):
        u = rng.choice("aaaabc")
        body = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        rows.append((i, f"https://{u}.example.org/{i}", f"<html><head><title>t</title></head><nav>{nav[u]}</nav><p>{body}</p><footer>&copy; {nav[u][:20]} all rights reserved by the owner of this</footer>", 1, "x"))
    return rows


@pytest.mark.parametrize("pieces", [{}, {"piece_tokens": 150}, {"host_bytes": 0}, {"host_bytes": 3000, "piece_tokens": 60}])
@pytest.mark.parametrize("k", [3, 8])
def test_equals_a_suffix_array_by_sorting(spark, pieces, k):
    rows = [*corpus(), (100, None, None, 1, "x"), (101, "https://a.example.org/", "", 1, "x"), (None, "nonsense", "<p>lonely words only", 1, "x")]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in h.extract(df, k, **pieces).collect()), key=str)
    assert got == brute(rows, k)
    assert any(r[3] for r in got) and any(r[2] - r[3] for r in got)


def test_visible_tokens():
    page = "<!DOCTYPE html><head><title>no</title></head><body><script>var t='</p>';</script>a<b>b</b><br>c &amp; d<!-- x --><p>e<style>p{}</style>f 1 < 2<li>g</li><a href='>'>h"
    assert h.visible_tokens(page) == ["ab", "c", "&", "d", "e", "f", "1", "<", "2", "g", "'>h"]
    assert h.visible_tokens(None) == h.visible_tokens("<script>unclosed") == []


def test_hosts(spark):
    urls = [None, "", "x", "HTTP://U:p@Ex.org:80/a", "https://e.org?q"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(h.host_of(h.col("u"))).collect()
    assert [r[0] for r in got] == [host_of(u) for u in urls] == ["", "", "", "ex.org", "e.org"]


def test_ranks_agree_with_windows():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 13):
        ranks = h.prefix_ranks(ids, "host", k)
        windows = [tuple(ids[i : i + k]) for i in range(len(ids) - k + 1)]
        assert len(set(zip(ranks.tolist(), windows))) == len(set(ranks.tolist())) == len(set(windows))


def test_empty_table_and_very_long_page(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert h.extract(df).collect() == []
    long = "<p>" + " ".join(f"t{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, "http://x/", long, 1, ""), (2, "http://x/", "<p>" + " ".join(f"t{i}" for i in range(100, 120)), 1, "")], SCHEMA)
    got = {r.page_id: r for r in h.extract(df).collect()}
    assert got[2].n_removed == 20 and got[1].n_removed == 20 and got[1].text.count("\n") == 1


@pytest.mark.parametrize("pieces", [{}, {"host_bytes": 0}])
def test_chance_repeats_of_a_rank_stay(spark, pieces):
    texts = ["w264 w871 w270 w289 w779 w425 w414 w382", "w622 w174 w90 w353 w998 w626 w512 w596"]
    ranks = [h.prefix_ranks(np.array([h.xxhash.xxh3_64_intdigest(t) for t in x.split()], np.uint64), "x", 8).tolist() for x in texts]
    assert ranks[0] == ranks[1]  # two windows of one rank, found by search
    rows = [(i, "http://x/", "<p>" + texts[j], 1, "") for i, j in enumerate([0, 1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert [r.n_removed for r in h.extract(df, **pieces).collect()] == [0, 0]
    # where one of the two is really repeated, only it goes
    df = spark.createDataFrame([*rows, (2, "http://x/", "<p>" + texts[0], 1, "")], SCHEMA).repartition(3)
    assert {r.page_id: r.n_removed for r in h.extract(df, **pieces).collect()} == {0: 8, 1: 0, 2: 8}


def test_hosts_do_not_repeat_each_other_and_hot_hosts_are_cut(spark):
    same = "<p>" + " ".join(f"t{i}" for i in range(30))
    apart = [(i, f"http://h{i}.org/", same, 1, "") for i in range(40)]
    assert sum(r.n_removed for r in h.extract(spark.createDataFrame(apart, SCHEMA).repartition(4)).collect()) == 0
    hot = [(i, "http://hot.org/", f"<p>own{i} " * 12 + same, 1, "") for i in range(200)]
    got = h.extract(spark.createDataFrame(hot + apart, SCHEMA).repartition(4), piece_tokens=300, host_bytes=9000).collect()
    assert {r.n_removed for r in got if r.host == "hot.org"} == {30} and sum(r.n_removed for r in got if r.host != "hot.org") == 0
    assert all(r.text == " ".join([f"own{r.page_id}"] * 12) for r in got if r.host == "hot.org")


def test_suffix_classes_order_windows():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 3, 400)
    for k in (1, 2, 3, 5, 8, 13):
        classes = h.suffix_classes(ids, k)
        windows = [tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1)]
        numbers = {w: i for i, w in enumerate(sorted(set(windows)))}
        assert np.argsort(classes, kind="stable").tolist() == sorted(range(len(windows)), key=lambda i: (numbers[windows[i]], i))
        assert len(set(zip(classes.tolist(), windows))) == len(numbers)
