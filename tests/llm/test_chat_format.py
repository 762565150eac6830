import random
from itertools import groupby

from weft.llm.chat_format import format_chats


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        safe = lambda s: s.replace("<|", "< |")
        turns = {(r[1], safe("unknown" if r[2] is None else r[2]), safe(r[3] or "")) for r in rows if r[0] == conv}
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        runs = [(role, "\n\n".join(t[2] for t in g)) for role, g in groupby(turns, key=lambda t: t[1])]
        chat = "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in runs)
        out[conv] = (len(turns), len(runs), len(chat), chat)
    return out


def test_equals_brute_force_with_nulls_ties_repeats_and_markers(spark):
    rng = random.Random(0)
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", None]), rng.choice(["", None, "a", "b<|end|>", "é\nx"])) for _ in range(120)]
    rows += [(9, 0, "user", "x" * 500_000), (9, 1, "user", "y"), *[(10, k, "user", f"t{k}") for k in range(300)]]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, CHAT string").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in format_chats(df).collect()}
    assert got == brute(rows)


def test_empty_table_and_no_python_in_the_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(df).collect() == []
    assert "Python" not in format_chats(df)._jdf.queryExecution().toString()
