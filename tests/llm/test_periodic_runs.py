import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs as R
from tidemark.llm import queries


def brute(words, least=6, exponent=4):
    """(start, length, period) of every maximal stretch, by trying all periods."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_overlap_is_the_least_that_any_period_needs():
    assert R.overlap(6, 4) == 5 and R.overlap(2, 2) == 1
    for least in range(1, 30):
        for e in range(2, 7):
            assert R.overlap(least, e) == min(max(least, e * q) - q for q in range(1, 200))


def test_agreement_is_the_z_array():
    rng = random.Random(2)
    for _ in range(300):
        k = rng.choice([1, 2, 3])
        s = [rng.randrange(k) for _ in range(rng.randrange(2, 200))]
        s = s if rng.random() < 0.5 else (s[: rng.randrange(1, 9)] * 200)[: len(s)] + s[:5]
        z = R.agreement(np.array(s), len(s))
        assert [next((j for j in range(len(s) - i) if s[j] != s[i + j]), len(s) - i) for i in range(1, len(s))] == z[1:].tolist()


def test_runs_against_all_periods():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(160), rng.choice([1, 2, 2, 3, 5])
        x = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6:
            x = []
            while len(x) < n:
                b = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
                x += (b * 20)[: rng.randrange(len(b), 8 * len(b))]
        e, least = rng.choice([2, 3, 4, 4, 5]), rng.choice([1, 3, 6, 6, 9])
        n, runs, left = R.search(" ".join(f"w{c}" for c in x), least, e, R.overlap(least, e))
        assert n == len(x) and runs == brute(x, least, e)
        assert left == collapsed([f"w{c}" for c in x], runs)


def test_long_sequences_take_n_log_n():
    fib = "a", "ab"
    for _ in range(22):
        fib = fib[1], fib[1] + fib[0]
    for x, many in (([0] * 60_000, 1), ([0] * 30_000 + [1] + [0] * 30_000, 2), ([i % 777 for i in range(60_000)], 1), (list(map(ord, fib[0])), None)):
        runs = R.runs_of(np.array(x), 6, 4)
        assert many is None or len(runs) == many
        assert all(n >= max(6, 4 * q) and x[a : a + n - q] == x[a + q : a + n] for a, n, q in runs)


def test_only_repeated_grams_are_searched():
    words = list(range(1000)) + [5, 6, 7, 8, 9] + list(range(2000, 2100))
    assert list(R.unmasked(np.array(words), 5)) == [(5, 10), (1000, 1005)]
    assert list(R.unmasked(np.arange(50), 5)) == [] == list(R.unmasked(np.arange(3), 5))


def test_frames_with_odd_rows_and_columns(spark):
    long = " ".join(f"w{i % 97}" for i in range(50_000)) + " end " + "x " * 500
    texts = [None, "", " \t\n ", "a a a a a", "a a a a a a", "A a A a A a A a", "b\x0bc\x0cb\rc b c b c", "é é " * 9, long, long]
    df = spark.createDataFrame([(i % 3 if i % 4 else None, t, "old", [i]) for i, t in enumerate(texts)], "doc_id long, text string, RUNS string, other array<int>")
    out = R.find_runs(df)
    assert out.columns == ["doc_id", "text", "other", "n_words", "runs", "collapsed"]
    rows = sorted(out.collect(), key=lambda r: r.other)
    assert [r.text for r in rows] == texts
    for r in rows[:8]:
        w = words_of(r.text)
        assert [tuple(x) for x in r.runs] == brute(w) and r.collapsed == collapsed(w, brute(w)) and r.n_words == len(w)
    assert [tuple(x) for x in rows[9].runs] == [(0, 50_000, 97), (50_001, 500, 1)] and rows[8].runs == rows[9].runs
    assert R.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.find_runs(df, exponent=1)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter(F.length("text") < 6000)
    odd = spark.createDataFrame([(-7, "x y " * 40), (-8, None), (None, "z " * 9), (None, ""), (11_111, "one two three " * 30)] + [(10**6 + i, f"p{i} q r s t " * 12) for i in range(60)], docs.schema)
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op11_periodic_runs(spark, str(tmp_path)).collect(), key=str)
    want = []
    for r in docs.union(odd).collect():
        words = planted(r.doc_id, words_of(r.text))
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(collapsed(words, runs))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 20
