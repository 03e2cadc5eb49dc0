import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def check(spark, docs, items, window=4, **more):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "item_id": F.lit(1)})
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.find_overlap(d, b, window, **more).collect()}
    assert got == {i: brute(t, [x for x in items if x[0] is not None], window) for i, t in enumerate(docs)}


def test_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "c.", "été", "d-e"]) for _ in range(n))
    docs = [text(rng.randint(0, 60)) for _ in range(150)] + [None, "", "...", "a " * 5000]
    items = [(i % 13, text(rng.randint(0, 9))) for i in range(15)] + [(20, "a"), (21, None), (22, "")]
    check(spark, docs, items)
    check(spark, docs, items, block_bytes=20)
    check(spark, docs, [])


def test_null_item_hits_without_a_name(spark):
    b = spark.createDataFrame([(None, "x y z")], "item_id long, text string")
    r = D.find_overlap(spark.createDataFrame([("w X, y z",)], "text string"), b, 3).first()
    assert (r.n_words, r.n_hit, r["items"], r.spans) == (4, 3, [], [[1, 4]])


def test_tables_skip_most_positions():
    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    block = D.Block([("1", " ".join(f"w{i}" for i in range(13))), ("2", " ".join(f"v{i}" for i in range(13)))], 13)
    (s,) = block.searchers
    for word in (-1, block.numbers[b"w0"]):  # a word that no item has, and one that ends no test string
        Counted.reads = 0
        assert list(s.find(Counted([word] * 1200))) == [] and Counted.reads < 250


def test_blocks_are_bounded_in_memory():
    import subprocess
    import sys

    code = """
import random, resource, sys
from tidemark.llm import decontaminate as D
rng = random.Random(1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
items = [(str(i), " ".join("w%d" % rng.randrange(300000) for _ in range(400))) for i in range(6000)]
size = sum(len(t) for _, t in items)
block = D.Block(items, 13)
assert block.search(D.words_of("zz " + items[5][1][:300]))[1] == ["5"]
print(size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=D.__file__.rsplit("/", 3)[0]).stdout.split()
    size, used = map(int, out)
    assert size > 15 << 20 and used < 500 << 20, (size, used)


def test_repeated_strings_and_a_long_window(spark):
    items = [(i, "a b c d e f " + ("g" if i % 2 else "h")) for i in range(40)]
    check(spark, ["a b c d e f g h", "x a b c d e f h", "f g"], items)
    check(spark, [" ".join(f"w{i}" for i in range(700))], [(1, " ".join(f"w{i}" for i in range(50, 400)))], window=300)


def test_a_very_long_text(spark):
    long = "lorem ipsum dolor " * 100_000 + "a b c d e"
    check_one = D.find_overlap(spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame([(7, "A b. c-D")], "item_id long, text string"), 4).first()
    assert (check_one.n_words, check_one.n_hit, check_one["items"], check_one.spans) == (300_005, 4, ["7"], [[300_000, 300_004]])


def test_rule_and_empty_documents(spark):
    got = spark.createDataFrame([(0, 0), (20, 1), (21, 1), (1, 1)], "a long, b long").select(D.contaminated(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [False, True, False, True]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert D.find_overlap(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_comparisons_do_not_grow_with_the_benchmark(monkeypatch):
    """Zipf text of which a third is one word: buckets grow with the benchmark, yet a position
    meets less than one string that begins as the text does."""
    rng = np.random.default_rng(9)
    draw = lambda n: [f"w{k}" for k in (rng.zipf(1.3, n) % 5000).tolist()]
    told, walked, plain = [], [], D.Searcher.alike

    def counted(self, spot, first):
        low, high = plain(self, spot, first)
        told.append(high - low)
        walked.append(self.heads[spot + 1] - self.heads[spot])
        return low, high

    monkeypatch.setattr(D.Searcher, "alike", counted)
    words, benchmark, seen = [w.encode() for w in draw(20_000)], draw(160_000), []
    for n in (20_000, 160_000):
        told.clear(), walked.clear()
        D.Block([("x", " ".join(benchmark[:n]))], 13).search(words)
        seen.append((sum(told) / len(words), sum(walked) / len(words)))
    (few, bucket), (more, larger) = seen
    assert larger > 8 * bucket and more < larger / 500 and more < 1
