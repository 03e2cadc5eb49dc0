"""Chat formatting in budgeted windows, with built-in functions only.

A conversation becomes one or more windows, each a string of whole turns::

    ### role: text</turn>

Texts and roles are escaped so that neither ``###`` nor ``</turn>`` can occur in
them, and can be restored exactly. Prefix sums of the turns' tokens choose the
windows: each takes as many new turns as the budget allows, after the system
turn and as many earlier turns as the history budget allows. What a window
repeats is never a target again: loss spans cover new assistant texts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Window beginnings that are appended to together.
CHUNK = 256


def escape(text: Column) -> Column:
    """Double every backslash, then break every ``#`` and ``</`` with one."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rough_tokens(text: Column) -> Column:
    """Words and single symbols, each as many tokens as it has spans of four characters."""
    return F.regexp_count(text, F.lit(r"\w{1,4}|[^\w\s]"))


def format_windows(
    conversations: DataFrame,
    budget: int = 512,
    history: int = 128,
    history_turns: int = 4,
    tokens: Callable[[Column], Column] = rough_tokens,
    target: str = "assistant",
) -> DataFrame:
    """One row per window of each conversation.

    Input: conv_id, turn, role, text; other columns are ignored. Output: conv_id,
    window (from 0), formatted, n_repeated (turns at its start that earlier
    windows have), n_new, n_tokens, spans (array of start, length: code points of
    ``formatted`` that bear loss).

    Turns are ordered by turn (nulls first), ties by role and text; repeated rows
    are turns of their own. Null texts and roles are empty. A null conv_id is a
    conversation. A window's tokens stay within ``budget``, but for a single turn
    that passes it alone: that turn stands whole, without history and with the
    system turn. Only a first turn of role ``system`` is retained. History takes at
    most ``history`` tokens and ``history_turns`` turns. An empty table gives none.

    A conversation may have any number of turns: only a few numbers of each turn come
    together in a row, texts meet in the windows that they stand in.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(MIDDLE))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("block", F.concat("head", "body", F.lit(CLOSE)))
    rows = rows.select(
        "conv_id", "turn", "role", "text", "block", F.length("head").alias("at"), F.length("body").alias("size"),
        tokens(F.col("block")).cast("long").alias("t"), F.length("block").cast("long").alias("c"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "tt": F.sum("t").over(upto), "cc": F.sum("c").over(upto), "kept": F.first(F.col("role") == "system").over(upto), "t0": F.first("t").over(upto)})
    # where a window that begins at a turn would take its history from
    rows = rows.withColumns({"tb": F.col("tt") - F.col("t"), "ahead": F.when(F.col("kept") & (F.col("i") > 0), F.col("t0")).otherwise(0)})
    rows = rows.withColumns({f"b{k}": F.lag("tb", k).over(order) for k in range(1, history_turns + 1)})
    fits = lambda k: (F.col("i") - k >= F.col("kept").cast("int")) & (F.col("tb") - F.col(f"b{k}") <= history) & (F.col("ahead") + F.col("tt") - F.col(f"b{k}") <= budget)
    deepest = range(history_turns, 0, -1)
    back = F.coalesce(*[F.when(fits(k), k) for k in deepest], F.lit(0))
    most = F.coalesce(*[F.when(fits(k), F.col(f"b{k}")) for k in deepest], F.col("tb")) - F.col("ahead") + budget
    turns = rows.select("conv_id", "kept", F.struct("i", "tt", (F.col("i") - back).alias("from"), most.alias("most")).alias("x"))
    # numbers only: a fold over them tells where windows begin, in chunks that are cheap to append to
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"), F.count("*").cast("int").alias("n"), F.first("kept").alias("kept"))
    starts = F.expr(f"""
        aggregate(turns,
          named_struct('most', cast(null as bigint), 'now', cast(array() as array<struct<start:int,from:int>>), 'done', cast(array() as array<array<struct<start:int,from:int>>>)),
          (s, x) -> if(coalesce(x.tt <= s.most, false), s, named_struct(
            'most', x.most,
            'now', if(size(s.now) = {CHUNK}, array(named_struct('start', x.i, 'from', x.from)), array_append(s.now, named_struct('start', x.i, 'from', x.from))),
            'done', if(size(s.now) = {CHUNK}, array_append(s.done, s.now), s.done))),
          s -> flatten(array_append(s.done, s.now)))
    """)  # fmt: skip
    windows = whole.select("conv_id", "n", "kept", starts.alias("starts")).select("conv_id", "n", "kept", F.posexplode("starts").alias("window", "w"))
    after = F.lead("w.start").over(Window.partitionBy("conv_id").orderBy("window"))
    windows = windows.select("conv_id", "window", "kept", "w.start", "w.from", F.coalesce(after, F.col("n")).alias("end"))
    places = F.expr("""concat(if(kept and start > 0, array(named_struct('place', -1, 'i', 0)), cast(array() as array<struct<place:int,i:int>>)),
                              transform(sequence(from, end - 1), x -> named_struct('place', x, 'i', x)))""")
    members = windows.select(F.col("conv_id").alias("__conv"), "window", "start", F.explode(places).alias("p")).select("__conv", "window", "start", "p.place", F.col("p.i").alias("__i"))
    parts = rows.select("conv_id", "i", "block", "at", "size", "t", "c", "tt", "cc", (F.col("role") == target).alias("goal"))
    met = members.join(parts, F.col("__conv").eqNullSafe(F.col("conv_id")) & (F.col("__i") == F.col("i")))
    own, part = F.col("place") >= 0, F.struct("place", "start", "block", "at", "size", "c", "cc", "goal")
    grouped = met.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        (F.max(F.when(own, F.col("tt"))) - F.min(F.when(own, F.col("tt") - F.col("t"))) + F.coalesce(F.sum(F.when(~own, F.col("t"))), F.lit(0))).alias("n_tokens"),
        (F.min(F.when(own, F.col("cc") - F.col("c"))) - F.coalesce(F.sum(F.when(~own, F.col("c"))), F.lit(0))).alias("skipped"),
    )
    new = lambda x: x["place"] >= x["start"]
    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda x: x["block"]), "").alias("formatted"),
        F.size(F.filter("parts", lambda x: ~new(x))).alias("n_repeated"),
        F.size(F.filter("parts", new)).alias("n_new"),
        "n_tokens",
        F.transform(F.filter("parts", lambda x: new(x) & x["goal"]), lambda x: F.struct((x["cc"] - x["c"] - F.col("skipped") + x["at"]).cast("int").alias("start"), x["size"].alias("length"))).alias("spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted string, restored."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda p: F.startswith(p, F.lit(OPEN)))
    head = r"(?s)^### ((?:[^\\:]|\\.)*): "

    def turn(p: Column) -> Column:
        lead = F.regexp_extract(p, head, 0)
        return F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.substring(p, F.length(lead) + 1, F.length(p) + 1)).alias("text"))

    return F.transform(parts, turn)


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations from their windows: conv_id, turns (array of role, text), loss
    (all text that bears loss, in order, restored), n_windows, formatted_chars."""
    loss = F.array_join(F.transform("spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])), "")
    rows = windows.select(
        "conv_id", "window", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"),
        F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_new")).alias("turns"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        unescape(F.array_join(F.transform("w", lambda x: x["loss"]), "")).alias("loss"), "n_windows", "formatted_chars",
    )
