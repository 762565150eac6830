"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores p = sigmoid(bias + sum of the weights of its words and word
prefixes); the document scores by noisy-or, 1 - prod(1 - p), so one bad sentence is enough. Weights are trained
from document labels alone (numpy, Adam) on at most ``max_rows`` labelled rows of each class and ``max_chars``
characters, taken in the order of a hash of their identifiers; everything else covers every document and whole texts. A document is rejected if its
noisy-or score reaches the threshold chosen on held-out labelled rows and at least one sentence is located, that is
scores 0.5 or more by itself: many harmless sentences don't add up to a rejection. The score given is the noisy-or in
either case.

Defined results: a null or blank text scores 0 and has no sentences; labels that are null, or without their
document, teach nothing, and of several labels for one document the largest counts; without labelled rows of both
classes nothing is toxic. Repeated rows are scored each for itself. Columns of the input pass unchanged.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

#: Labelled rows of each class that the model is fitted on.
MAX_ROWS = 3000
#: Characters of those rows together: they are fitted in the driver.
MAX_CHARS = 1 << 26
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("prob", T.DoubleType())])


@dataclass
class ToxicityModel:
    """Weights by feature, the bias of a sentence and the document score from which a document is rejected."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    threshold: float = 2.0


def _features(word: str) -> list[str]:
    return [word, *(f"{n}^{word[:n]}" for n in PREFIXES if len(word) > n)]


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of the sentences that have a word."""
    out = []
    for m in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(m.group().lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, seed: int = 7) -> ToxicityModel:
    """Fits the model on a bounded sample of the labelled documents: rows, not only identifiers, and characters."""
    marked = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(col(label_col).cast("int")).alias("y"))
    in_order = (F.xxhash64("id"), F.col("id"))
    ranked = [marked.where(F.col("y") == y).orderBy(*in_order).limit(max_rows) for y in (0, 1)]
    # at most 2 * max_rows identifiers, whatever the tables hold
    text = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(ranked[0].unionByName(ranked[1])), "id")
    rows = [text.where(F.col("y") == y).orderBy(*in_order, F.xxhash64("text")).limit(max_rows) for y in (0, 1)]
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(*in_order, F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows[0].unionByName(rows[1]).withColumn("chars", so_far).where(F.col("chars") <= max_chars)
    got = sorted(((r.id, r.y, r.text) for r in kept.collect()), key=lambda r: (str(r[0]), str(r[2])))
    return train([r[2] for r in got], [r[1] for r in got], seed)


def _telling(texts: list[str | None], y: list[int], z: float) -> dict[str, int]:
    """Features that occur in toxic documents more often than chance explains, by a two-proportion test.

    Only features of three toxic documents and more are counted further, and no document's words are kept.
    """
    seen: tuple[dict[str, int], dict[str, int]] = {}, {}
    for c in (1, 0):
        for text, label in zip(texts, y):
            if label == c:
                words = set(WORD.findall((text or "").lower()))
                for f in {f for w in words for f in _features(w)}:
                    if c or f in seen[1]:
                        seen[c][f] = seen[c].get(f, 0) + 1
        if c:
            few = {f: k for f, k in seen[1].items() if k >= 3}
            seen[1].clear()
            seen[1].update(few)
    n1, out = sum(y), {}
    n0 = len(y) - n1
    for f, k1 in seen[1].items():
        k0 = seen[0].get(f, 0)
        p = (k0 + k1 + 1) / (n0 + n1 + 2)
        if (k1 / n1 - k0 / n0) >= z * math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1)):
            out[f] = len(out)
    return out


def train(texts: list[str | None], y: list[int], seed: int = 7, epochs: int = 40, rate: float = 0.08, l2: float = 2e-5, held_out: float = 0.2, z: float = 4.0) -> ToxicityModel:
    """Noisy-or maximum likelihood by Adam over documents, on features that pass a test at ``z`` deviations; the
    threshold comes from the held-out fifth."""
    if len(set(y)) < 2:
        return ToxicityModel()
    rng = np.random.default_rng(seed)
    order, labels = rng.permutation(len(y)), np.array(y)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        mine = order[labels[order] == c]
        held[mine[: int(held_out * len(mine))]] = True
    # neither weights nor the choice of features see the held-out rows
    index = _telling([t for t, h in zip(texts, held) if not h], [c for c, h in zip(y, held) if not h], z)
    flat, of_sentence, first = [], [], [0]
    total = 0
    for text in texts:
        bag = sentences(text)
        for _, _, words in bag:
            ids = [index[f] for w in words for f in _features(w) if f in index]
            flat.append(np.array(ids, np.int32))
            of_sentence.append(len(ids))
        total += len(bag)
        first.append(total)
    lengths = np.array(of_sentence, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([*flat, np.zeros(0, np.int32)])
    first = np.array(first)
    y = np.array(y, float)
    fit_on = [d for d in order if not held[d]]
    balance = np.where(y == 1, 1.0, min(1.0, 2 * y.sum() / max(1, (y == 0).sum())))
    w = np.zeros(len(index) + 1)
    w[-1] = -5.0
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0

    def forward(docs):
        sents = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs]) if len(docs) else np.zeros(0, int)
        doc_of = np.repeat(np.arange(len(docs)), [first[d + 1] - first[d] for d in docs])
        n = lengths[sents]
        at = np.repeat(starts[sents] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(sents) else np.zeros(0, int)
        feats, sent_of = flat[at], np.repeat(np.arange(len(sents)), n)
        s = np.bincount(sent_of, w[feats], len(sents)) + w[-1]
        quiet = np.bincount(doc_of, np.logaddexp(0, s), len(docs))
        return s, doc_of, feats, sent_of, quiet

    for _ in range(epochs):
        rng.shuffle(fit_on)
        for i in range(0, len(fit_on), 128):
            docs = fit_on[i : i + 128]
            s, doc_of, feats, sent_of, quiet = forward(docs)
            odds = np.exp(-np.minimum(quiet, 500)) / np.maximum(-np.expm1(-quiet), 1e-9)
            pull = np.where(y[docs] == 1, -odds, 1.0) * balance[docs]
            g_s = pull[doc_of] / (1 + np.exp(-np.clip(s, -500, 500))) / len(docs)
            g = np.bincount(feats, g_s[sent_of], len(w)) + l2 * w
            g[-1] = g_s.sum()
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    names = list(index)
    model = ToxicityModel({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w[:-1]) > 0.02)}, float(w[-1]), 0.5)
    tested = np.flatnonzero(held) if held.any() and len(set(y[held])) == 2 else np.arange(len(y))
    scores = np.array([_deciding(*_judge(texts[d], model, {})) for d in tested])
    best = (-1.0, 0.5)
    for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95):
        hit = scores >= t
        f1 = 2 * (hit & (y[tested] == 1)).sum() / max(1, hit.sum() + y[tested].sum())
        best = max(best, (round(float(f1), 4), -t if t > 0.5 else -0.5), key=lambda b: b)
    model.threshold = abs(best[1])
    return model


def _judge(text: str | None, model: ToxicityModel, cache: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
    """Noisy-or score and located sentences of one text."""
    quiet, spans, get, weights = 0.0, [], cache.get, model.weights
    for m in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(m.group().lower()))
        if not words:
            continue
        s = model.bias
        for word in words:
            x = get(word)
            if x is None:
                x = cache[word] = sum(weights.get(f, 0.0) for f in _features(word))
            s += x
        quiet += max(s, 0.0) + math.log1p(math.exp(-abs(s)))
        if s >= 0:
            spans.append((m.start(), m.end(), 1 / (1 + math.exp(-s))))
    return -math.expm1(-quiet), spans


def _deciding(score: float, spans: list) -> float:
    """What is held to the threshold: the noisy-or of a text with a located sentence, else nothing."""
    return score if spans else 0.0


def _cached(cache: dict, limit: int = 400_000) -> dict:
    if len(cache) > limit:
        cache.clear()
    return cache


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic, spans) for every row; spans are the located sentences' character ranges and scores."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType()), T.StructField("spans", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("prob", pa.float64())]))

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            judged = [_judge(t, model, _cached(cache)) for t in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "prob": round(p, 6)} for a, b, p in s] for _, s in judged]
            scores = [round(x, 6) for x, _ in judged]
            toxic = [_deciding(*x) >= model.threshold for x in judged]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(toxic, pa.bool_()), pa.array(spans, kind)], names=["doc_id", "score", "toxic", "spans"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)


def reject(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, columns unchanged; one pass, no join."""
    at = docs.columns.index(text_col)

    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            stays = [_deciding(*_judge(t, model, _cached(cache))) < model.threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
