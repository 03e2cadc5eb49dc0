import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language as L
from tidemark.llm import queries
from tidemark.llm.common import held_out


def brute(sample, text):
    """Longest-match phrases by substring search."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at, count = at + n, count + 1
    return count


def test_phrases_against_substring_search():
    rng = random.Random(2)
    for _ in range(40):
        sample = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 80)))
        texts = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 60))) for _ in range(6)]
        code = lambda s: np.array(["abcde".index(c) for c in s], np.int32)
        table = L.automaton(code(sample), L.CLASSES).ravel()
        ends = np.cumsum([len(t) for t in texts])
        got = L.phrases(table, code("".join(texts)), ends - [len(t) for t in texts], ends)
        assert got.tolist() == [brute(sample, t) for t in texts], (sample, texts)
        for stretch in (1, 3, 7):
            assert L.phrases(table, code("".join(texts)), ends - [len(t) for t in texts], ends, stretch=stretch).tolist() == got.tolist()


def test_matches_longer_than_stretches():
    sample, texts = "ab" * 400 + "c", ["ab" * 5000, "ba" * 700 + "c" + "ab" * 900, "", "d" * 50 + "ab" * 30]
    code = lambda s: np.array(["abcd".index(c) for c in s], np.int32)
    table, ends = L.automaton(code(sample), L.CLASSES).ravel(), np.cumsum([len(t) for t in texts])
    for stretch in (16, 512, 1 << 20):
        assert L.phrases(table, code("".join(texts)), ends - [len(t) for t in texts], ends, stretch=stretch).tolist() == [brute(sample, t) for t in texts]


def test_query_against_substring_search(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    samples = {k: L.plain(s) for k, s in L.fit(docs.filter(~held_out())).samples.items()}  # joined pieces may meet in two blanks
    got = {r.doc_id: r for r in queries.op4_language(spark, sf).collect()}
    rows = docs.collect()
    assert len(rows) == len(got)
    for r in rows:
        t = L.plain(r.text or "")
        if not t.strip():
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        bits = {k: math.log2(len(s) + 2) * brute(s, t) / len(t) for k, s in samples.items()}
        best = min(sorted(bits), key=bits.get)
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - 1 / bits[best] / sum(1 / b for b in bits.values())) < 1e-9


def test_plain():
    assert L.plain("Ab, 12\n  É!") == "ab é " and L.plain("") == ""


def test_undetermined_and_clashing_columns(spark):
    model = L.LanguageModel({"xx": "abc abd abe " * 5, "yy": "zyx zyw zyv " * 5})
    texts = [None, "", "12 !", "ABD abc", "zyx-zyw", "zyx-zyw", "q" * 70000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    rows = L.predict(df, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows][:6] == ["und", "und", "und", "xx", "yy", "yy"] and rows[6].lang_pred in ("xx", "yy")
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].score == 0
    assert [r.lang_pred for r in L.predict(df, L.fit(df.limit(0).withColumn("lang", F.lit("x")))).collect()] == ["und"] * 7
    assert L.predict(df.limit(0), model).count() == 0


def test_sample_is_bounded_and_skips_nulls(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 9 = 0 then null else concat('word', id, ' some text ') end as text", "case when id % 5 = 0 then null when id = 7 then 'rare' else 'big' end as lang")
    model = L.fit(df, sample_chars=1000)
    assert set(model.samples) == {"big", "rare"} and len(model.samples["big"]) == 1000


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 200


def test_more_characters_than_the_table_has_columns(spark):
    rng = random.Random(5)
    han = [chr(0x4E00 + i) for i in range(400)]  # both languages use all of them, in other words
    words = {k: ["".join(rng.sample(han, 4)) for _ in range(300)] for k in ("xx", "yy")}
    model = L.LanguageModel({k: "".join(rng.choices(w, k=4000)) for k, w in words.items()})
    code = model.codes("".join(han))
    assert len(set(code.tolist())) == 400 and L.CLASSES - 1 not in code and model.codes("é").tolist() == [L.CLASSES - 1]
    for _, table, rare, _ in model.tables():
        texts = ["".join(rng.choices(words[k], k=6)) for k in words for _ in range(4)]
        coded = [model.codes(t) for t in texts]
        ends = np.cumsum([len(c) for c in coded])
        sample = [s for s in model.samples.values() if len(L.split_automaton(model.codes(s), L.CLASSES)[1][0]) == len(rare[0])][0]
        got = L.phrases(table, np.concatenate(coded), ends - [len(c) for c in coded], ends, rare, stretch=4)
        assert got.tolist() == [brute(sample, t) for t in texts]
    texts = [(i, "".join(rng.choices(words[("xx", "yy")[i % 2]], k=8))) for i in range(40)]
    rows = L.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert all(r.lang_pred == ("xx", "yy")[r.doc_id % 2] for r in rows)
