"""Quality by positive-unlabelled learning.

A small network scores a text by its form: shares of characters by kind, repetition, lengths. It minimises the
non-negative risk of Kiryo et al. (2017) over trusted positives (labels of quality 1) and unlabelled documents,
``p R_pos(+) + max(0, R_unl(-) - p R_pos(-))`` with the sigmoid loss: where the second term falls below zero, its
gradient is reversed. The class prior p is estimated first, by the best top bin of Garg et al. (2021): the least
ratio of unlabelled to positive rows above a score of a positive-against-unlabelled classifier. Labels of quality 0
are not used.

At most ``max_rows`` labelled rows are fitted, in the order of a hash of their identifiers. Every document is an
unlabelled row: standardisation and the prior's counts are taken over all of them (but for the prior those that its classifier was
fitted on), and so is the unlabelled term of the risk. The network starts from weights fitted on ``max_rows`` documents and
descends from there in ``steps`` passes over the features of all; the weights of the least risk over the table stay.

A document is kept if it scores 0.5 or more, or as much as all but a hundredth of the held-out trusted positives.

Defined results: a null or blank text scores 0 and isn't kept; null identifiers are scored like others; labels that
are null or lack their document teach nothing; with less than MIN_ROWS positives or documents all texts with a word
score 1; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stored

MAX_ROWS, STEPS, MIN_ROWS = 4000, 8, 8
_MARKS = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
N_FEATURES = len(_MARKS) + 13


def features(text: str) -> np.ndarray:
    """Numbers on the form of a whole text; none depends on the language's vocabulary."""
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    distinct, sentences = set(words), seen[33] + seen[46] + seen[63] + 1
    packed = len(zlib.compress(raw, 1))
    form = [
        np.log1p(n),
        np.log1p(len(words)),
        n / (len(words) + 1),
        len(distinct) / (len(words) + 1),
        len(words) / sentences,
        len(set(lines)) / len(lines),
        len(lines) / (len(words) + 1),
        packed / (n + 20),
        seen[48:58].sum() / n,
        seen[65:91].sum() / n,
        seen[97:123].sum() / n,
        seen[128:].sum() / n,
        max(map(len, words), default=0) / (max(map(len, distinct), default=0) + sum(map(len, distinct)) / (len(distinct) + 1) + 1),
    ]
    return np.array([*form, *(seen[_MARKS] / n)], np.float32)


@dataclass
class QualityModel:
    """Standardisation, one hidden layer, the class prior and the least score kept."""

    layers: list[np.ndarray] | None = None
    prior: float = 1.0
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.ones(len(x))
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, x)[0], -60, 60)))


def _forward(layers, x):
    mean, scale, w1, b1, w2, b2 = layers
    z = np.clip((x - mean) / scale, -8, 8)
    h = np.tanh(z @ w1 + b1)
    return h @ w2 + b2[0], h, z


def _slopes(layers, x, g) -> list[np.ndarray]:
    """Gradients of the weights from those of the scores."""
    _, h, z = _forward(layers, x)
    gh = g[:, None] * layers[4] * (1 - h * h)
    return [z.T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()])]


def _descend(x_p, x_u, mean, scale, risk, seed: int, epochs: int, rate: float = 0.01, hidden: int = 16) -> list[np.ndarray]:
    """Adam on the gradients with respect to the scores of positives and unlabelled rows that ``risk`` gives."""
    rng = np.random.default_rng(seed)
    layers = [mean, scale, rng.normal(0, 0.2, (x_p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.2, hidden), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step, batches = 0, max(1, len(x_u) // 256)
    for _ in range(epochs):
        p_parts, u_parts = np.array_split(rng.permutation(len(x_p)), batches), np.array_split(rng.permutation(len(x_u)), batches)
        for ip, iu in zip(p_parts, u_parts):
            if not len(ip) or not len(iu):
                continue
            x = np.concatenate([x_p[ip], x_u[iu]])
            s = _forward(layers, x)[0]
            grads = [None, None, *_slopes(layers, x, risk(s[: len(ip)], s[len(ip) :]))]
            step += 1
            for k in range(2, 6):
                grad = grads[k] + 1e-4 * layers[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                layers[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return layers


def _logistic(s_p, s_u):
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -60, 60)))
    return np.concatenate([(sig(s_p) - 1) / len(s_p), sig(s_u) / len(s_u)])


def non_negative_risk(prior: float):
    """Gradients of the non-negative unbiased risk, sigmoid loss; reversed where its second term is negative."""

    def risk(s_p, s_u):
        sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -60, 60)))
        slope_p, slope_u = sig(s_p) * (1 - sig(s_p)) / len(s_p), sig(s_u) * (1 - sig(s_u)) / len(s_u)
        rest = sig(s_u).mean() - prior * sig(s_p).mean()
        if rest < 0:
            return np.concatenate([prior * slope_p, -slope_u])
        return np.concatenate([-prior * slope_p - prior * slope_p, slope_u])

    return risk


def class_prior(s_p: np.ndarray, cuts: np.ndarray, above: np.ndarray, n_u: int, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: s_p are scores of positives, ``above`` counts the n_u unlabelled rows
    that score as much as each cut; neither were trained on."""
    q_p = 1 - np.searchsorted(np.sort(s_p), cuts) / len(s_p)
    q_u = above / n_u
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(s_p)) + 1 / np.sqrt(n_u))
    best = np.argmin((q_u + slack) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def _written(column: pa.Array) -> np.ndarray:
    return np.array([bool((t.as_py() or "").strip()) for t in column], bool)


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, x) of every document with a word: identifier, its hash, features."""

    def run(batches):
        for batch in batches:
            kept = batch.filter(pa.array(_written(batch.column(2))))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([features(t).tobytes() for t in kept.column(2).to_pylist()], pa.binary())], names=["id", "h", "x"])

    slim = docs.select(col(id_col).alias("id"), F.xxhash64(col(id_col)).alias("h"), col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, h long, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)


def _over_all(rows: DataFrame, part) -> np.ndarray:
    """The sum over a table of features of what ``part`` makes of each batch, a vector; summed by Spark."""

    def run(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + part(_matrix(batch.column(0)))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["k", "value"])

    got = rows.select("x").mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).orderBy("k").collect()
    return np.array([r.value for r in got])


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -60, 60)))


def table_risk(rows: DataFrame, n: int, x_p: np.ndarray, layers: list[np.ndarray], prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk with all n rows as unlabelled ones, and its gradients (those of the reversal where it applies)."""

    def part(x):
        sig = _sigmoid(_forward(layers, x)[0])
        return np.concatenate([[sig.sum()], *(g.ravel() for g in _slopes(layers, x, sig * (1 - sig)))])

    sums = _over_all(rows, part) / n
    s_p = _sigmoid(_forward(layers, x_p)[0])
    rest = sums[0] - prior * s_p.mean()
    slopes_p = _slopes(layers, x_p, s_p * (1 - s_p) / len(x_p))
    grads, at = [], 1
    for g in slopes_p:
        u = sums[at : at + g.size].reshape(g.shape)
        grads.append(prior * g - u if rest < 0 else u - 2 * prior * g)
        at += g.size
    return float(prior * (1 - s_p.mean()) + max(0.0, rest)), grads


def train(rows: DataFrame, positive: np.ndarray, max_rows: int = MAX_ROWS, steps: int = STEPS, seed: int = 3, epochs: int = 40) -> QualityModel:
    """Fits on features of trusted positives and a table (id, h, x) of all documents."""
    n = rows.count()
    if len(positive) < MIN_ROWS or n < MIN_ROWS:
        return QualityModel()
    sums = _over_all(rows, lambda x: np.concatenate([x.sum(0), (x * x).sum(0)])) / n
    mean = sums[:N_FEATURES]
    scale = np.sqrt(np.maximum(sums[N_FEATURES:] - mean * mean, 0)) + 1e-3
    few = rows.orderBy("h", "id", "x").limit(min(max_rows, n // 2)).collect()
    sample = np.frombuffer(b"".join(bytes(r.x) for r in few), np.float32).reshape(-1, N_FEATURES).astype(float)
    p = positive[np.random.default_rng(seed).permutation(len(positive))]
    held_p, fit_p = p[: len(p) // 4], p[len(p) // 4 :]
    apart = _descend(fit_p, sample, mean, scale, _logistic, seed, epochs)
    s_p = _forward(apart, held_p)[0]
    cuts = np.unique(s_p)
    # the last place counts all rows
    reach = lambda x: np.append(len(x) - np.searchsorted(np.sort(_forward(apart, x)[0]), cuts), len(x)).astype(float)
    unseen = _over_all(rows.where(F.col("h") > few[-1].h), reach)
    prior = class_prior(s_p, cuts, unseen[:-1], int(unseen[-1])) if len(unseen) else 0.5
    layers = _descend(fit_p, sample, mean, scale, non_negative_risk(prior), seed, epochs)
    best, least, slope, rate = layers, np.inf, [], 0.2
    for _ in range(steps + 1):
        risk, grads = table_risk(rows, n, fit_p, layers, prior)
        if risk < least:
            best, least, slope = layers, risk, grads
        else:
            rate /= 2
        norm = np.sqrt(sum((g * g).sum() for g in slope)) + 1e-12
        layers = best[:2] + [w - rate * g / norm for w, g in zip(best[2:], slope)]
    model = QualityModel(best, prior)
    model.threshold = float(min(0.5, np.quantile(model.score(held_p), 0.01)))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, steps: int = STEPS) -> QualityModel:
    """Fits on a bounded sample of the trusted positives and on all documents."""
    rows = stored(_featured(docs, id_col, text_col), "features")
    trusted = labels.where((col(label_col) == 1) & col(id_col).isNotNull()).select(col(id_col).alias("id")).distinct()
    chosen = trusted.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # identifiers and, as a table may repeat them, rows are bounded
    got = rows.join(F.broadcast(chosen), "id", "left_semi").orderBy("h", "id", "x").limit(max_rows).select("x").collect()
    return train(rows, np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(-1, N_FEATURES).astype(float), max_rows, steps)


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep) for every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            scores = np.zeros(len(texts))
            written = np.flatnonzero(_written(texts))
            if len(written):
                scores[written] = model.score(np.array([features(texts[int(i)].as_py()) for i in written], float))
            scores = scores.round(6)
            keep = (scores >= round(model.threshold, 6)) & np.isin(np.arange(len(texts)), written)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(keep)], names=["doc_id", "score", "keep"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, keep boolean")
