import random

import numpy as np

from weft.llm import quality as q

SCHEMA = "doc_id long, text string, x string, KEEP int"


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows, good = [], {}
    for i in range(n):
        good[i] = rng.random() < 0.4
        sentence = lambda: " ".join(rng.choices(vocab, k=rng.randint(5, 15))).capitalize() + "."
        text = " ".join(sentence() for _ in range(rng.randint(2, 12)))
        if not good[i]:
            text = " ".join(w.upper() + rng.choice(["!!", "###", "$$$", " 999"]) for w in text.split())
        rows.append((i, text, "x", 1))
    return rows, good


def fitted(spark):
    rows, good = corpus()
    docs = spark.createDataFrame([*rows, (None, "Words and words here.", "x", 1), (9000, None, "x", 1), (9001, " \n", "x", 1), (9002, "ok " * 400_000, "x", 1), rows[0]], SCHEMA).repartition(4)
    trusted = [i for i in good if good[i]][:250]
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(None, 1), (3, None), (70_000, 1), (trusted[0], 1)], "doc_id long, quality int")
    return docs, q.fit(docs, labels), good


def test_held_out_accuracy_without_negatives(spark):
    docs, model, good = fitted(spark)
    assert 0.25 <= model.prior <= 0.6
    got = [r for r in q.classify(docs, model).collect()]
    assert len(got) == docs.count()
    right = [r.keep == good[r.doc_id] for r in got if r.doc_id in good]
    assert np.mean(right) > 0.95
    odd = {r.doc_id: (r.score, r.keep) for r in got if r.doc_id in (9000, 9001)}
    assert odd == {9000: (0.0, False), 9001: (0.0, False)}


def test_risk_is_non_negative_and_reverses():
    risk = q.non_negative_risk(0.5)
    s_p, s_u = np.array([3.0, 2.0]), np.array([-4.0, -3.0, -5.0])
    step = lambda f, i, s: (f(s + np.eye(len(s))[i] * 1e-6) - f(s - np.eye(len(s))[i] * 1e-6)) / 2e-6
    sig = lambda s: 1 / (1 + np.exp(-s))
    # sigmoid loss: l(s, +) = sig(-s), l(s, -) = sig(s)
    g = risk(s_p, s_u)  # the second term is negative: ascend it
    rest = lambda a, b: sig(b).mean() - 0.5 * sig(a).mean()
    assert rest(s_p, s_u) < 0
    assert np.allclose(g[2:], [-step(lambda s: rest(s_p, s), i, s_u) for i in range(3)])
    s_u = np.array([4.0, 3.0, 5.0])
    g = risk(s_p, s_u)
    whole = lambda a, b: 0.5 * sig(-a).mean() + rest(a, b)
    assert np.allclose(g[:2], [step(lambda s: whole(s, s_u), i, s_p) for i in range(2)])
    assert np.allclose(g[2:], [step(lambda s: whole(s_p, s), i, s_u) for i in range(3)])


def test_prior_and_risk_equal_brute_force_over_the_table(spark):
    rng = np.random.default_rng(4)
    s_p, s_u = rng.normal(2, 1, 200), np.concatenate([rng.normal(2, 1, 300), rng.normal(-3, 1, 700)])
    cuts = np.unique(s_p)
    got = q.class_prior(s_p, cuts, np.array([(s_u >= c).sum() for c in cuts]), len(s_u))
    slack = np.sqrt(np.log(40) / 2) * (200**-0.5 + 1000**-0.5)
    ratios = [((s_u >= c).mean() + slack) / (s_p >= c).mean() for c in cuts]
    c = cuts[int(np.argmin(ratios))]
    assert got == (s_u >= c).mean() / (s_p >= c).mean() and abs(got - 0.3) < 0.06
    rows, _ = corpus(120)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    feats = q._featured(docs, "doc_id", "text")
    x = np.array([q.features(r[1]) for r in rows], np.float32).astype(float)
    layers = [x.mean(0), x.std(0) + 1e-3, rng.normal(0, 0.3, (x.shape[1], 4)), rng.normal(0, 0.3, 4), rng.normal(0, 0.3, 4), np.array([0.1])]
    for prior in (0.2, 0.9):  # the second reverses
        sig = lambda ls, a: 1 / (1 + np.exp(-q._forward(ls, a)[0]))
        rest = lambda ls: sig(ls, x).mean() - prior * sig(ls, x[:30]).mean()
        whole = lambda ls: prior * (1 - sig(ls, x[:30])).mean() + rest(ls)
        risk, grads = q.table_risk(feats, len(rows), x[:30], layers, prior)
        assert np.isclose(risk, prior * (1 - sig(layers, x[:30])).mean() + max(0, rest(layers)))
        aim = whole if rest(layers) >= 0 else lambda ls: -rest(ls)
        for k in (3, 4):
            for i in range(4):
                up, down = [w.copy() for w in layers], [w.copy() for w in layers]
                up[k][i] += 1e-5
                down[k][i] -= 1e-5
                assert np.isclose(grads[k - 2][i], (aim(up) - aim(down)) / 2e-5, atol=1e-6)


def test_scores_equal_the_network_by_hand(spark):
    docs, model, _ = fitted(spark)
    mean, scale, w1, b1, w2, b2 = model.layers
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.classify(docs, model).orderBy("doc_id").limit(60).collect():
        if (texts[r.doc_id] or "").strip():
            z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(q.features(texts[r.doc_id]).tolist(), mean, scale)]
            s = sum(np.tanh(sum(a * w for a, w in zip(z, w1[:, j])) + b1[j]) * w2[j] for j in range(len(w2))) + b2[0]
            assert abs(r.score - 1 / (1 + np.exp(-s))) < 2e-6 and r.keep == (r.score >= round(model.threshold, 6))


def test_repeated_identifiers_do_not_burst_the_sample(spark):
    rows, good = corpus(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    many = docs.unionByName(docs.where("doc_id = 5").crossJoin(spark.range(3000)).drop("id"))
    trusted = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    model = q.fit(many, trusted, max_rows=100, steps=1)
    assert model.layers is not None and q.classify(many, model).count() == 3060


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", "x", 1), (2, "", "x", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: (r.score, r.keep) for r in q.classify(docs, q.fit(docs, none)).collect()} == {1: (1.0, True), 2: (0.0, False)}
    empty = docs.limit(0)
    assert q.classify(empty, q.fit(empty, none)).collect() == []
