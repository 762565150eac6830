import random
import re

import pytest

from weft.llm import toxicity as t

BAD = ["trash", "moron", "clown"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    out = []
    for i in range(n):
        sents = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 12))]
        y = int(rng.random() < 0.3)
        if y:
            at = rng.randrange(len(sents))
            sents[at] = sents[at].replace(" ", f" {rng.choice(BAD)} ", 1)
        out.append((i, ". ".join(sents) + ".", y))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(700, 1)
    return t.train([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_accuracy_and_location(model):
    right = located = toxic = 0
    rows = corpus(400, 2)
    for _, text, y in rows:
        s, spans = t._judge(text, model, {})
        right += (s >= model.threshold) == bool(y)
        if y:
            toxic += 1
            located += any(re.search("|".join(BAD), text[a:b]) for a, b, _ in spans)
    assert right / len(rows) > 0.97 and located / toxic > 0.95


def test_scores_equal_brute_force_noisy_or(spark, model):
    rows = corpus(60, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for r in t.score(df, model).collect():
        clean, any_located = 1.0, False
        for s in re.split(r"[.!?\n]", rows[r.doc_id][1]):
            words = set(re.findall(r"\w+", s.lower()))
            if words:
                z = model.bias + sum(model.weights.get(f, 0) for w in words for f in [w] + [f"{n}^{w[:n]}" for n in (4, 5, 6) if len(w) > n])
                p = 1 / (1 + 2.718281828459045**-z)
                clean *= 1 - p
                any_located |= p >= 0.5
        assert r.score == pytest.approx(1 - clean, abs=1e-5)
        assert r.toxic == (any_located and 1 - clean >= model.threshold)


def test_nulls_blanks_long_texts_repeats_and_clashing_columns(spark, model):
    long = "fine words here. " * 60_000 + "you moron you clown you trash."
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (3, " \n!!", 3, "c"), (4, long, 4, "d"), (5, "what trash moron clown", 5, "e"), (5, "what trash moron clown", 5, "e"), (None, "ok", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, TOXIC string")
    got = t.score(df, model).collect()
    assert sorted((r.doc_id or 0, r.toxic) for r in got) == [(0, False), (1, False), (2, False), (3, False), (4, True), (5, True), (5, True)]
    (span,) = next(r.spans for r in got if r.doc_id == 4)
    assert "moron" in long[span.start : span.end]
    kept = t.reject(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3]


def test_fit_without_both_classes_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "trash")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 0)], "doc_id long, toxic int")
    assert t.fit(docs, labels).weights == {}
    assert [r.toxic for r in t.score(docs, t.fit(docs, labels.limit(0))).collect()] == [False]
    assert t.score(docs.limit(0), t.ToxicityModel()).collect() == []


def test_fit_is_bounded_and_deterministic(spark):
    rows = corpus(300, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    a, b = (t.fit(df.repartition(n), df, max_rows=60) for n in (2, 5))
    assert a == b and a.weights


def test_repeated_identifiers_and_long_texts_do_not_burst_the_sample(spark, monkeypatch):
    rows = corpus(80, 6)
    hot = rows[0][:1] + ("a hot text. " * 50, rows[0][2])
    df = spark.createDataFrame(rows + [hot] * 2000, "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(t, "train", lambda texts, y, seed: seen.append(texts) or t.ToxicityModel())
    t.fit(df, df, max_rows=50)
    t.fit(df, df, max_rows=50, max_chars=5000)
    assert len(seen[0]) <= 100 and len(seen[1]) < len(seen[0]) and sum(map(len, seen[1])) <= 5000
