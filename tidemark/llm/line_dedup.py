"""Line deduplication by a deletion-neighbourhood join, with built-in functions only.

Two lines within one edit share a variant: a character of each left out at the
same place, or one line and the other less a character. Each variant is a hashed
key, and a key's earliest line is all that its others need be compared with: two
lines that lack the same place's character are one substitution apart whatever it
was, and a line and those that lack one more character than it are one deletion
apart. So no pairs are made within a key, however many lines share it.

Lines that share neither half with any other line cannot have such a neighbour;
only those that do emit variants, and only of the other half.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import Cuts, unused

#: Shorter lines, in normalised characters, have no neighbours.
MIN_CHARS = 20
#: Words of a filter that spares rows a shuffle (4 MB). Past 16 bits for each key it
#: passes more rows than it need; what is joined in the end is the same.
SIEVE_WORDS = 1 << 19

#: A line's identity: two hashes of its normal form.
LINE = ["h1", "h2"]


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value worked out once, however often an inner function uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def half_keys(line: str) -> list[Column]:
    """Hashes of a line without one half, as the shorter or equal, and as the longer
    of a pair: (length of the shorter, half left out, what stands before and behind)."""
    out = []
    for less in (0, 1):
        n = F.length(line) - less
        half = F.shiftright(n, 1)
        out.append(F.xxhash64(n, F.lit(0), F.right(line, n - half)))
        out.append(F.xxhash64(n, F.lit(1), F.left(line, half)))
    return out


def part_keys(line: str, edits: int) -> list[Column]:
    """Hashes of the parts of a line cut into edits + 1, as the shorter or equal of a
    pair, and of what may be the other's parts in it, as the longer: (length of the
    shorter, part, text). Edits leave one part as it is, moved by so many at most."""
    out, n = [], F.length(line)
    for less in range(edits + 1):
        m = n - less
        for t in range(edits + 1):
            start, end = (F.floor(m * j / (edits + 1)).cast("int") for j in (t, t + 1))
            for move in range(-edits, edits + 1):
                at = start + move
                fits = (m >= 0) & (at >= 0) & (at + end - start <= n)
                out.append(F.when(fits, F.xxhash64(m, F.lit(t), F.substring(line, at + 1, end - start))))
    return out


def _wide_pairs(lines: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(h1, h2, e): lines and the earliest of those that share a variant within the edits.

    A variant has some characters marked and some left out. Two lines that share
    one with m marks, having left out i and j, are within m + i + j edits, and any
    two within the bound share such a one."""
    rows = lines.join(texts, LINE).selectExpr(*LINE, "first", "0 as s", "0 as d", "0 as p", "line as part", "true as open")
    at = "if(p < length(part), sequence(p, length(part) - 1), cast(array() as array<int>))"
    one = "named_struct('s', {}, 'd', {}, 'p', {}, 'part', {}, 'open', {})"
    stop = f"array({one.format('s', 'd', 'p', 'part', 'false')})"
    mark = one.format("s + 1", "d", "q + 1", r"concat(left(part, q), '\n', substring(part, q + 2))", "true")
    drop = one.format("s", "d + 1", "q", "concat(left(part, q), substring(part, q + 2))", "true")
    for _ in range(edits):
        rows = rows.select(*LINE, "first", F.expr(f"explode(if(open, concat({stop}, transform({at}, q -> {mark}), transform({at}, q -> {drop})), {stop})) as x")).select(*LINE, "first", "x.*")
    rows = rows.select(*LINE, "first", "s", "d", F.xxhash64("s", "part").alias("v"))
    whole = Window.partitionBy("v")
    rows = rows.withColumns({f"l{i}": F.min(F.when(F.col("d") == i, F.struct("first", *LINE))).over(whole) for i in range(edits + 1)})
    e = F.array_min(F.array(*[F.when(F.col("s") + F.col("d") + i <= edits, F.col(f"l{i}")) for i in range(edits + 1)]))
    return rows.withColumn("e", e).filter("e.first < first").select(*LINE, "e").distinct()


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Lines of documents (d, th, text), by place, with hashes of their normal form."""
    rows = docs.select("d", "th", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    rows = rows.select("d", "th", "i", normal(F.col("line")).alias("line")).filter(F.length("line") >= min_chars)
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def _sieve(cuts: Cuts, keys: DataFrame) -> bloom.Bloom:
    return bloom.build(cuts, keys, bloom.words_for(keys.count(), 16, SIEVE_WORDS))


def _shared_parts(cuts: Cuts, lines: DataFrame) -> DataFrame:
    """Lines with each of their keys (j, k) that another line has too.

    Keys are counted, and only rows of the shared ones are joined: as most keys are
    of one line, a filter of the shared ones lets few rows through. A part that very
    many lines share is a large group of plain scans, which adaptive execution splits."""
    shared = cuts.cut(lines.select(F.explode("keys").alias("k")).filter("k is not null").groupBy("k").count().filter("count > 1").select("k"))
    parts = lines.select(*LINE, "first", F.posexplode("keys").alias("j", "k")).filter(F.col("k").isNotNull() & _sieve(cuts, shared).passes(F.col("k")))
    return cuts.cut(cuts.cut(parts).join(shared, "k"))


def _neighbours(cuts: Cuts, lines: DataFrame, docs: DataFrame, edits: int = 1) -> DataFrame:
    """The distinct lines (h1, h2) that have an earlier one within the edits."""
    halves = _shared_parts(cuts, lines)
    wanted = halves.select(*LINE, "first").distinct().groupBy(F.col("first.d").alias("wd"), F.col("first.th").alias("wth")).agg(F.collect_list(F.struct("first.i", *LINE)).alias("of"))
    wanted = cuts.cut(wanted)
    sieve = _sieve(cuts, wanted.select(F.xxhash64("wd", "wth").alias("key")))
    found = docs.filter(sieve.passes(F.xxhash64("d", "th"))).join(wanted, F.col("d").eqNullSafe(F.col("wd")) & F.col("th").eqNullSafe(F.col("wth")))
    pieces = once(F.split("text", "\n", -1), lambda own: F.transform("of", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), normal(F.get(own, x["i"])).alias("line"))))
    found = found.select(F.explode(pieces).alias("x"))
    texts = cuts.cut(found.select("x.*").dropDuplicates(LINE))
    if edits > 1:
        pairs = _wide_pairs(halves.select(*LINE, "first").distinct(), texts, edits)
        return _checked(pairs, texts, edits)
    block = halves.join(texts, LINE).selectExpr(*LINE, "first", "k", "line", "length(line) as n", "j < 2 as even", "j % 2 as side", "if(j < 2, length(line), length(line) - 1) as m")
    block = block.selectExpr(*LINE, "first", "k", "even", "if(side = 0, left(line, n - (m - shiftright(m, 1))), substring(line, shiftright(m, 1) + 1)) as part")
    place = "if(part = '', cast(array() as array<int>), sequence(0, length(part) - 1))"
    variants = block.select(
        *LINE,
        "first",
        F.explode(F.expr(f"""
            if(even,
               concat(array(struct(1 as role, xxhash64(k, -1, part) as v)),
                      transform({place}, p -> struct(0 as role, xxhash64(k, p, left(part, p), substring(part, p + 2)) as v))),
               transform({place}, p -> struct(2 as role, xxhash64(k, -1, concat(left(part, p), substring(part, p + 2))) as v)))
        """)).alias("x"),
    ).select(*LINE, "first", "x.role", "x.v")
    # the distinct lines of one variant differ in one character at one place, or are one character longer: no group is larger
    # than the characters in use times a line's places
    whole = Window.partitionBy("v")
    line = F.struct("first", *LINE)
    least = {name: F.min(F.when(F.col("role") == role, line)).over(whole) for role, name in enumerate(("same", "full", "less"))}
    near = variants.withColumns(least).withColumn("e", F.expr("case role when 0 then same when 1 then less else full end"))
    return _checked(near.filter("e.first < first").select(*LINE, "e").distinct(), texts, edits)


def _checked(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The lines of the pairs (h1, h2; e with the other's) that are within the edits."""
    other = texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("other"))
    pairs = pairs.select(*LINE, F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).join(texts, LINE).join(other, ["e1", "e2"])
    return pairs.filter(F.levenshtein("line", "other", edits) >= 0).select(*LINE).distinct()


def dedup_lines(df: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id", min_repeat: int | None = None) -> DataFrame:
    """Drop repeated lines from ``text``; append n_lines and n_dropped.

    Lines are compared after trimming blanks and lower-casing. A line goes where the
    same line occurs at an earlier place, or, with ``max_edits``, where any earlier
    line is within so many edits (a character put in, taken out or replaced),
    whether or not that one stays. With a bound k of 2 or more a line that shares a
    part with another has about (2n)^k / k! variants for n characters. Place: document key (null last), then line
    number. What stays keeps its order and its original form. Lines under
    ``min_chars`` characters always stay, but for those of ``min_repeat`` or more
    that occur at an earlier place as they are: what that finds needs no variants.

    Null texts stay null, with no lines; an empty text is one empty line. Repeated
    rows share their places, so they keep the same lines; clashing keys with other
    texts are ordered by a hash of the text. Texts of any length and number of lines
    are taken whole; an empty table gives no rows. Columns named n_lines and n_dropped
    are replaced, all others pass.
    """
    if max_edits < 0:
        raise ValueError("max_edits: 0 or more")
    cuts = Cuts(df.sparkSession)
    place = F.struct(F.col("d").isNull().alias("last"), "d", "i", "th")
    docs = df.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    keys = half_keys("line") if max_edits < 2 else part_keys("line", max_edits)
    floor = min_chars if min_repeat is None else min(min_repeat, min_chars)
    if floor < min_chars:
        keys = [F.when(F.length("line") >= min_chars, k) for k in keys]
    rows = _lines(docs, floor).select("h1", "h2", place.alias("place"), *[k.alias(f"k{j}") for j, k in enumerate(keys)])
    lines = rows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"), *[F.min(f"k{j}").alias(f"k{j}") for j in range(len(keys))])
    every = F.array(*[f"k{j}" for j in range(len(keys))])
    lines = cuts.cut(lines.select("h1", "h2", "first", "n", (F.when(F.coalesce(*[f"k{j}" for j in range(len(keys))]).isNotNull(), every) if floor < min_chars else every).alias("keys")))
    near = cuts.cut(_neighbours(cuts, lines, docs, max_edits) if max_edits else lines.select(*LINE).limit(0))
    said = lines.join(near.withColumn("near", F.lit(True)), LINE, "left").filter("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    said = cuts.cut(said)
    gone = _lines(docs, floor).select("d", "th", "i", *LINE).join(said, LINE)
    gone = gone.filter(F.col("near") | ~(F.col("d").eqNullSafe(F.col("first.d")) & (F.col("i") == F.col("first.i")) & (F.col("th") == F.col("first.th"))))
    gd, gth, which = unused(df, "gd", "gth", "gone")
    gone = gone.groupBy(F.col("d").alias(gd), F.col("th").alias(gth)).agg(F.collect_set("i").alias(which))
    all_lines = F.split(text, "\n", -1)
    out = df.join(gone, F.col(key).eqNullSafe(F.col(gd)) & F.xxhash64(text).eqNullSafe(F.col(gth)), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(which))
    kept = once(all_lines, lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))
    return out.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines)).cast("long"),
        "n_dropped": F.when(F.col(which).isNull(), 0).otherwise(F.size(which)).cast("long"),
        text: F.when(F.col(which).isNull(), F.col(text)).otherwise(kept),
    }).drop(gd, gth, which)
