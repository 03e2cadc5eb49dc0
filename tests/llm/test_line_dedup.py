import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as L


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, edits, least):
    """docs: (id, text) with distinct ids; the same rule by comparing all pairs."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    seen, out = [], {}
    for d in order:
        key, text = docs[d]
        if text is None:
            out[key] = (None, 0, 0)
            continue
        lines, kept = text.split("\n"), []
        for line in lines:
            x = line.strip(" ").lower()
            if len(x) < least:
                kept.append(line)
                continue
            if not any(x == y or (edits and within_one(x, y)) for y in seen):
                kept.append(line)
            seen.append(x)
        out[key] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def run(spark, docs, edits=1, least=6):
    df = spark.createDataFrame([(k, t, "n", "d") for k, t in docs], "doc_id long, text string, n_lines string, gone string")
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in L.dedup_lines(df, edits, least).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 12))) for _ in range(8)]

    def line():
        s = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            p, how = rng.randrange(len(s)), rng.randrange(3)
            s[p : p + (how != 0)] = [] if how == 1 else rng.choice("abé")
        return rng.choice(["", " "]) + ("".join(s) if rng.random() < 0.9 else "ab")

    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 5)))) for i in range(60)] + [(None, "\n".join(line() for _ in range(4))), (99, None), (98, ""), (97, "\n\n")]
    assert run(spark, docs) == brute(docs, 1, 6)
    assert run(spark, docs, edits=0) == brute(docs, 0, 6)
    assert run(spark, docs, least=0) == brute(docs, 1, 0)


def test_every_place_of_an_edit(spark):
    base = "abcdefghijklmnopqrstuvw"
    changed = [base[:i] + "#" + base[i + 1 :] for i in range(len(base))] + [base[:i] + "#" + base[i:] for i in range(len(base) + 1)] + [base[:i] + base[i + 1 :] for i in range(len(base))]
    docs = [(0, base)] + list(enumerate(changed, 1))
    assert all(n == 1 for k, (_, _, n) in run(spark, docs).items() if k)


def test_repeated_rows_long_text_and_empty_table(spark):
    long = "\n".join(f"line number {i * 7919} of a long one" for i in range(20000))
    df = spark.createDataFrame([(5, "same line here"), (5, "same line here"), (7, "Same line here \nother"), (9, long)], "doc_id long, text string")
    rows = [(r.doc_id, r.text, r.n_dropped) for r in L.dedup_lines(df, min_chars=6).orderBy("doc_id").collect()]
    assert rows[:3] == [(5, "same line here", 0)] * 2 + [(7, "other", 1)] and rows[3][0] == 9
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(5, "same line here")], "doc_id long, text string")
    plan = L.dedup_lines(df).withColumn("x", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_short_repeats_go_and_short_neighbours_stay(spark):
    docs = [(1, "and ornd.\nabc\n\nlong enough line"), (2, "And ornd. \nabd\n\nlong enough lines"), (3, "abc\n\nx\nx")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in L.dedup_lines(df, 1, 12, min_repeat=1).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("abd\n", 2), 3: ("\nx", 2)}


def test_no_repeat_is_left(spark):
    sf = "/root/testdata/sf0.01"
    from tidemark.llm import queries

    left = [x for r in queries.op8_line_dedup_whole(spark, sf).collect() for line in (r.text or "").split("\n") if (x := line.strip(" ").lower())]
    assert len(left) == len(set(left)) > 5000


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_two_edits_against_all_pairs(spark):
    rng = random.Random(6)
    docs = []
    for i in range(70):
        s = list(rng.choice(["abcabcabca", "bbacaacbabc", "cabbacbb"]))
        for _ in range(rng.randint(0, 4)):
            p, how = rng.randrange(len(s)), rng.randrange(3)
            s[p : p + (how != 0)] = [] if how == 1 else rng.choice("abcd")
        docs.append((i, "".join(s)))
    docs += [(70, "in year 1987 it was"), (71, "in year 1990 it was"), (72, "in yera 1988 it was")]
    want = {k for k, x in docs if len(x) >= 6 and any(len(y) >= 6 and edits_between(x, y) <= 2 for j, y in docs if j < k)}
    assert {k for k, (_, _, n) in run(spark, docs, edits=2).items() if n} == want and 71 in want and 72 not in want


def test_a_start_that_many_lines_share(spark):
    lines = [f"the common beginning of the lines {i * 7919 % 100003:06d} and ends {i % 13}" for i in range(4000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in L.dedup_lines(df).filter("n_dropped > 0").collect()}
    known, want = set(), set()
    for i, x in enumerate(lines):
        spots = {(p, x[:p] + x[p + 1 :]) for p in range(len(x))}
        if known & spots:
            want.add(i)
        known |= spots
    assert gone == want


def test_filter_passes_all_it_holds_whatever_its_size(spark):
    from tidemark.llm import bloom, common

    keys = spark.range(5000).selectExpr("id * 7 as key")
    for words in (1, 100, 5000):
        f = bloom.build(common.Cuts(spark), keys, words)
        assert keys.filter(f.passes(F.col("key"))).count() == 5000
    assert spark.range(100000).filter(f.passes(F.col("id") * 7 + 1)).count() < 1000
