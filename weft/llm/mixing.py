"""Mixing sources to target weights by raking (proportional fitting of marginals).

Token counts are summed by cell (source, language, topic); raking multiplies the cells, in turn and for a fixed
number of rounds, so that each marginal meets its target share. A cell's factor is its fitted over its observed
tokens; its documents are kept with probability factor / largest factor, so the scarcest cell stays whole and the
expected tokens have the target shares. One stray document in a rare cell can so set how much of the whole corpus
stays; with ``negligible`` above 0, rates are divided instead by the least factor whose larger ones belong to cells
that together hold at most that share of the fitted tokens. Those cells stay whole and fall short of their fit by
no more than they were to have, so each value's expected share is within negligible / (1 - negligible) of the one
fitted. A document's draw is a hash of its identifier: the same in every run. Rates
fitted in the driver go to the documents by broadcast, those fitted on tables by a join.

Targets are shares by value of a dimension; those left out are the observed shares to the power ``temperature``,
renormalised. Values a given target doesn't name get nothing; named values that don't occur are left out of the
total. The cells - as many as there are combinations of values - are fitted in the driver up to ``max_cells`` and,
beyond, by the same steps on tables in the shared folder.

Defined results: a null source, language or topic is a value of its own; a null text has no tokens and the topic
'none'; documents of a cell without tokens are kept; a null identifier draws like the empty string; repeated rows
share their draw; an empty table gives no rows. Columns of the input pass unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, named, stored

ROUNDS, TEMPERATURE, MAX_CELLS = 20, 0.9, 500_000
#: Share of the fitted tokens whose cells don't set the pipeline's scale; ``mix`` itself takes 0, as its SQL does.
NEGLIGIBLE = 0.01
DIMS = ("source", "lang", "topic")


#: Target shares of the topics: connected prose of both lengths, little of what is mostly marks and figures.
TOPICS = {"long": 0.6, "short": 0.38, "noise": 0.02}
#: What op2_mixing and the pipeline aim at; sources and languages keep their observed shares, flattened by TEMPERATURE.
TARGETS = {"topic": TOPICS}
_MARKS = r"[!-@\[-`{-~]"


def topic_of(text: Column) -> Column:
    """What kind of writing a text is, where the table has no topic of its own.

    'noise' if more than a third of its characters are ASCII marks and figures, else 'long' from 400 words and 'short'
    below; a null text is 'none'.
    """
    marks = F.regexp_count(text, F.lit(_MARKS))
    return F.when(text.isNull(), "none").when(marks * 3 > F.length(text), "noise").when(tokens_of(text) >= 400, "long").otherwise("short")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")).cast("long"), F.lit(0).cast("long"))


def draw(identifier: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from a hash of the identifier."""
    digest = F.md5(F.concat(F.coalesce(identifier.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def shares(values: list, tokens: np.ndarray, wanted: dict | None, temperature: float) -> np.ndarray:
    """Target share of each value of a dimension."""
    if wanted is not None:
        raw = np.array([float(wanted.get(v, 0.0)) for v in values])
    else:
        raw = np.array([(t / tokens.sum()) ** temperature if t > 0 else 0.0 for t in tokens])
    return raw / raw.sum() if raw.sum() > 0 else raw


def rake(codes: list[np.ndarray], tokens: np.ndarray, goals: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Fitted tokens of each cell: codes has each dimension's value number by cell, goals the shares by value."""
    w, total = tokens.astype(float), float(tokens.sum())
    for _ in range(rounds):
        for code, goal in zip(codes, goals):
            now = np.bincount(code, w, len(goal))
            w = w * np.divide(goal * total, now, out=np.zeros_like(now), where=now > 0)[code]
    return w


def scale(factor: np.ndarray, fitted: np.ndarray, negligible: float) -> float:
    """The least factor above which cells hold at most the negligible share of the fitted tokens; 1 if none is."""
    values, at = np.unique(factor, return_inverse=True)
    held = np.bincount(at, fitted, len(values)) if len(values) else np.zeros(0)
    above = np.cumsum(held[::-1])[::-1] - held
    fit = values[(values > 0) & (above <= negligible * fitted.sum())]
    return float(fit.min()) if len(fit) else 1.0


def cell_rates(cells: DataFrame, targets: dict[str, dict] | None = None, rounds: int = ROUNDS, temperature: float = TEMPERATURE, max_cells: int = MAX_CELLS, negligible: float = 0.0) -> DataFrame:
    """(source, lang, topic, prob) from (source, lang, topic, t): the rate at which a cell's documents are kept."""
    targets = targets or {}
    cells = stored(cells, "cells")
    if cells.count() > max_cells:
        return _rates_on_tables(cells, targets, rounds, temperature, negligible)
    got = cells.toPandas().sort_values(list(DIMS), na_position="first", kind="stable").reset_index(drop=True)
    tokens = got["t"].to_numpy(np.int64)
    codes, goals = [], []
    for d in DIMS:
        values = [None if v is None or v != v else v for v in got[d]]
        index = {v: i for i, v in enumerate(dict.fromkeys(values))}
        code = np.array([index[v] for v in values], int)
        sums = np.bincount(code, tokens, len(index)) if len(code) else np.zeros(0)
        codes.append(code)
        goals.append(shares(list(index), sums, targets.get(d), temperature))
    fitted = rake(codes, tokens, goals, rounds) if len(tokens) else tokens.astype(float)
    factor = np.divide(fitted, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    top = scale(factor, fitted, negligible) if negligible else factor.max() if len(factor) and factor.max() > 0 else 1.0
    rows = [(*(None if v is None or v != v else v for v in (r.source, r.lang, r.topic)), min(1.0, float(f / top)) if t > 0 else 1.0) for r, f, t in zip(got.itertuples(), factor, tokens)]
    # at most max_cells rows; unhinted, the documents would be shuffled before the planner sees how few they are
    return F.broadcast(cells.sparkSession.createDataFrame(rows, "source string, lang string, topic string, prob double"))


def _rates_on_tables(cells: DataFrame, targets: dict, rounds: int, temperature: float, negligible: float) -> DataFrame:
    """The steps of ``rake`` on tables, for more cells than a driver should hold; lineage is cut each round."""
    now = cells.withColumn("w", F.col("t").cast("double"))
    total = float(cells.agg(F.sum("t")).first()[0] or 0)
    for d in DIMS:
        sums = cells.groupBy(d).agg(F.sum("t").alias("s"))
        if d in targets:
            pairs = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv]) if targets[d] else F.lit(None).cast("map<string,double>")
            raw = sums.select(F.col(d).alias("v"), F.coalesce(pairs[F.col(d)].cast("double"), F.lit(0.0)).alias("raw"))
        else:
            raw = sums.select(F.col(d).alias("v"), F.when(F.col("s") > 0, F.pow(F.col("s") / total, temperature)).otherwise(0.0).alias("raw"))
        whole = raw.agg(F.sum("raw").alias("whole"))
        goal = raw.crossJoin(whole).select("v", F.coalesce(F.try_divide(F.col("raw"), F.col("whole")) * total, F.lit(0.0)).alias(f"goal_{d}"))
        now = now.join(goal, F.col(d).eqNullSafe(F.col("v")), "left").drop("v")
    now = stored(now, "cells")
    for _ in range(rounds):
        for d in DIMS:
            sums = now.groupBy(F.col(d).alias("v")).agg(F.sum("w").alias("s"))
            now = now.join(sums, F.col(d).eqNullSafe(F.col("v")), "left").withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.col(f"goal_{d}") / F.col("s")).otherwise(0.0)).drop("v", "s")
        now = stored(now, "cells")
    rated = now.withColumn("f", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0))
    if negligible:
        held = rated.where("f > 0").groupBy("f").agg(F.sum("w").alias("held"))
        above = F.coalesce(F.sum("held").over(Window.orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        limit = negligible * (rated.agg(F.sum("w")).first()[0] or 0.0)
        top = held.withColumn("above", above).where(F.col("above") <= limit).agg(F.min("f").alias("top"))
    else:
        top = rated.agg(F.max("f").alias("top"))
    return rated.crossJoin(top).select(*DIMS, F.when(F.col("t") > 0, F.when(F.col("top") > 0, F.least(F.col("f") / F.col("top"), F.lit(1.0))).otherwise(0.0)).otherwise(1.0).alias("prob"))


def mix(df: DataFrame, targets: dict[str, dict] | None = None, source: str = "source", lang: str = "lang", text: str = "text", topic: Column | None = None, identifier: str = "doc_id", rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: int = 0, max_cells: int = MAX_CELLS, report: bool = False, negligible: float = 0.0) -> DataFrame:
    """The sampled rows of ``df`` in its own columns or, as a report, (doc_id, source, lang, topic, tokens, prob)."""
    s, g, p, t, prob = named(df, "source", "lang", "topic", "tokens", "prob")
    keys = df.withColumns({s: col(source).cast("string"), g: col(lang).cast("string"), p: topic_of(col(text)) if topic is None else topic})
    cells = keys.groupBy(F.col(s).alias("source"), F.col(g).alias("lang"), F.col(p).alias("topic")).agg(F.sum(tokens_of(col(text))).alias("t"))
    rates = cell_rates(cells, targets, rounds, temperature, max_cells, negligible).select(F.col("source").alias("r_s"), F.col("lang").alias("r_l"), F.col("topic").alias("r_t"), F.col("prob").alias(prob))
    rated = keys.join(rates, F.col(s).eqNullSafe(F.col("r_s")) & F.col(g).eqNullSafe(F.col("r_l")) & F.col(p).eqNullSafe(F.col("r_t")))
    kept = rated.where(draw(col(identifier), seed) < F.col(prob))
    if report:
        return kept.select(col(identifier).alias("doc_id"), F.col(s).alias("source"), F.col(g).alias("lang"), F.col(p).alias("topic"), tokens_of(col(text)).alias("tokens"), F.round(prob, 6).alias("prob"))
    return kept.select(*[col(c) for c in df.columns])


def mixing_sql(table: str = "documents", targets: dict[str, dict] | None = None, rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: int = 0) -> str:
    """The report of ``mix`` over a table, in DuckDB's SQL: one step of raking to a common table expression."""
    targets = targets or {}

    def goal(x: str) -> str:
        """A value's share of the total: as wanted, or its observed share to the power; it counts once, though it has n cells."""
        if x in targets:
            raw = "CASE " + " ".join(f"WHEN {x} = '{v}' THEN {w}::DOUBLE" for v, w in targets[x].items()) + " ELSE 0.0 END"
        else:
            raw = f"pow(s_{x} / total, {temperature})"
        return f"total * {raw} / sum({raw} / n_{x}) OVER () AS g_{x}"

    steps = [
        f"""d AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN text IS NULL THEN 'none' WHEN len(regexp_extract_all(text, '{_MARKS}')) * 3 > length(text) THEN 'noise'
 WHEN tokens >= 400 THEN 'long' ELSE 'short' END AS topic, tokens FROM (SELECT *, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::BIGINT AS tokens FROM {table}))""",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t FROM d GROUP BY ALL)",
        "m AS MATERIALIZED (SELECT *, sum(t) OVER () AS total, " + ", ".join(f"sum(t) OVER (PARTITION BY {x}) AS s_{x}, count(*) OVER (PARTITION BY {x}) AS n_{x}" for x in DIMS) + " FROM c)",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, t, t AS w, " + ", ".join(map(goal, DIMS)) + " FROM m)",
    ]
    for k in range(rounds * len(DIMS)):
        x = DIMS[k % len(DIMS)]
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(w * g_{x} / nullif(sum(w) OVER (PARTITION BY {x}), 0), 0) AS w) FROM w{k})")
    steps.append(f"r AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN t > 0 THEN (w / t) / max(w / nullif(t, 0)) OVER () ELSE 1.0 END AS prob FROM w{rounds * len(DIMS)})")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT doc_id, d.source, d.lang, d.topic, tokens, round(prob, 6) AS prob FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic
WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 12))::BIGINT / {16**12}.0::DOUBLE < prob"""
    )
