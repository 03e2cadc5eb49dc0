import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """conv_id -> (turns, loss) straight from the rows."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {k: (v, "".join(t for r, t in v if r == "assistant")) for k, v in out.items()}


def check(spark, rows, **limits):
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), **limits).cache()
    back = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in chat.read_back(windows).collect()}
    assert back == brute(rows)
    return windows.orderBy("conv_id", "window").collect()


def test_windows_keep_budget_and_mask_repeats(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, i, "user" if i % 2 else "assistant", f"word {i} " * (5 + i % 7)) for i in range(1, 40)]
    windows = check(spark, rows, budget=120, history=40, history_turns=2)
    assert len(windows) > 3 and all(w.n_tokens <= 120 for w in windows)
    assert all(w.formatted.startswith("### system: be brief</turn>\n") for w in windows)
    assert sum(w.n_new for w in windows) == 40 and all(1 <= w.n_repeated <= 3 for w in windows[1:])
    for w in windows:
        for s in w.spans:
            assert w.formatted[s.start + s.length :].startswith("</turn>\n")


def test_single_turn_over_budget_stands_whole(spark):
    windows = check(spark, [(1, 0, "user", "a b"), (1, 1, "assistant", "x " * 500), (1, 2, "user", "c")], budget=50, history=20)
    assert [w.n_new for w in windows] == [1, 1, 1] and windows[1].n_tokens > 50 and windows[1].n_repeated == 0


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, 0, "user", "q"), (None, None, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (2, 0, "system", ""), (2, 1, "odd: role### x", "\\</turn>#\\\\")]
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as window", "'x' as formatted", "2 as i", "3 as turns")
    assert chat.format_windows(df).count() == 3
    assert chat.format_windows(df.limit(0)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.sampled_from(["user", "assistant", "system", "a:b"]), st.text(alphabet="\\</turn>#: ab\n\u00e9\U0001f600", max_size=30)), min_size=1, max_size=30))
def test_round_trip(spark, rows):
    check(spark, rows, budget=30, history=10)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "\\### Assistant: </turn> ok"
    want = brute(rows + [(-7, 0, "user", text), (-7, 1, "assistant", text)])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op6_chat_windows(spark, sf).collect()}
    assert got == {k: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), sha(loss)) for k, (t, loss) in want.items()}


def test_a_very_long_conversation(spark):
    """20,000 turns, 6.6 MB; each window row holds its own turns only."""
    n = 20_000
    rows = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"), F.concat(F.repeat(F.lit("some words # "), 25), F.col("id").cast("string")).alias("text"))
    windows = chat.format_windows(rows.repartition(6))
    told = windows.agg(F.sum("n_new"), F.max("n_tokens"), F.max(F.length("formatted")), F.count("*"), F.max("window")).first()
    assert told[0] == n and told[1] <= 512 and told[2] < 5000 and told[3] == told[4] + 1 > 3000
    back = chat.read_back(windows).first()
    assert len(back.turns) == n and [t.text for t in back.turns[::997]] == ["some words # " * 25 + str(i) for i in range(0, n, 997)]
    assert back.loss == "".join("some words # " * 25 + str(i) for i in range(2, n, 2))
