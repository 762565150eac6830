"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where the same role speaks on, and joined into one
string: ``<|role|>`` and a line break before a turn, ``<|end|>`` and a line break after it. No Python runs on rows.

Defined results: turns sort by (turn, role, text), nulls first; rows that repeat another in full count once; a null
role reads 'unknown', a null text is empty; ``<|`` within a role or text becomes ``< |``, so that no text forges a
marker; turns without a conversation's identifier are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

JOINT = "\n\n"


def _merged(turns: Column) -> Column:
    """Runs of one role as (role, text): linear in the turns and their text, as each run is sliced and joined once."""
    n = F.size(turns)
    role = lambda i: F.element_at(turns, i)["role"]
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (role(F.greatest(i - 1, F.lit(1))) != role(i)))
    run = lambda i, k: F.slice(turns, i, F.coalesce(F.get(starts, k + 1), n + 1) - i)
    text = lambda r: F.array_join(F.transform(r, lambda t: t["text"]), JOINT)
    return F.transform(starts, lambda i, k: F.struct(role(i).alias("role"), text(run(i, k)).alias("text")))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_merged, n_chars, chat), a row for each conversation."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    said = F.struct(col(turn).alias("turn"), safe(F.coalesce(col(role), F.lit("unknown"))).alias("role"), safe(F.coalesce(col(text), F.lit(""))).alias("text"))
    by = df.where(col(conv).isNotNull()).groupBy(col(conv).alias("conv_id")).agg(F.sort_array(F.collect_set(said)).alias("turns"))
    runs = by.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _merged(F.col("turns")).alias("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.lit("<|"), r["role"], F.lit("|>\n"), r["text"], F.lit("<|end|>\n")))
    chats = runs.select("conv_id", "n_turns", F.size("runs").cast("long").alias("n_merged"), F.array_join(lines, "").alias("chat"))
    return chats.select("conv_id", "n_turns", "n_merged", F.length("chat").cast("long").alias("n_chars"), "chat")


CHAT_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS k, role IS DISTINCT FROM lag(role) OVER w AS fresh FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY conv_id ORDER BY k) AS run FROM o),
r AS (SELECT conv_id, run, min(role) AS role, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text FROM g GROUP BY conv_id, run),
c AS (SELECT conv_id, sum(n)::BIGINT AS n_turns, count(*) AS n_merged, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY run) AS chat FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, n_merged, length(chat)::BIGINT AS n_chars, chat FROM c
"""
