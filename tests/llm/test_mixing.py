import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M
from tidemark.llm import queries

SCHEMA = "doc_id long, text string, source string, TARGET string"


def sizes_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(sizes, share=1.5, most=2, weights=M.WEIGHTS):
    """Targets by sharing the excess out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def corpus(n=400):
    rng = random.Random(8)
    names = ["a", "b", "", "é", "Z", None]
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.choice([0, 1, 3, 20, 80]))), rng.choice(["a", "a", *names]), "x") for i in range(n)]
    rows += [(n, " ".join(f"L{j}" for j in range(9000)), "a", ""), (n + 1, None, "a", ""), (n + 2, " \t ", "empty", ""), (None, "one two", "b", ""), (None, None, None, "")]
    return rows + [(5, "same text here", "b", "")] * 3 + [(6, "other", "b", "")] + [(7, "", "Z", "")] * 2


def test_permutation_is_one_and_backwards():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        p = M.Permutation(n, 1, 2)
        there = p.place(np.arange(n))
        assert sorted(there.tolist()) == list(range(n)) and (p.block(there) == np.arange(n)).all()
    big = M.Permutation(10**12, 3)
    x = np.random.default_rng(0).integers(0, 10**12, 2000)
    assert (big.block(big.place(x)) == x).all() and (big.place(x) < 10**12).all()
    assert abs(np.corrcoef(np.arange(5000), M.Permutation(5000, 9).place(np.arange(5000)))[0, 1]) < 0.05


def test_draws_give_the_quota_to_the_word():
    rng = random.Random(1)
    for _ in range(300):
        size, length = rng.randrange(1, 400), rng.randrange(1, 60)
        quota = rng.randrange(0, 2 * size + 1)
        d = M.Draws(rng.randrange(9), size, quota, length, 5)
        block, words = d.range(0, d.many)
        assert words.sum() == quota and (words > 0).all() and len(block) == d.many
        cut = sorted(rng.sample(range(d.many + 1), min(3, d.many + 1)))
        parts = [d.range(a, b - a) for a, b in zip([0, *cut], [*cut, d.many], strict=True)]
        assert np.concatenate([p[0] for p in parts]).tolist() == block.tolist()
        n = -(-size // length)
        for a in range(0, d.many, n):  # a pass takes no block twice
            some = block[a : a + n]
            assert len(set(some.tolist())) == len(some) and (a + n > d.many or len(some) == n)


def test_tree_deals_every_draw_once():
    quotas = np.array([1000, 0, 37, 1, 512])
    for shards in (1, 2, 7, 64):
        whole = sorted(M.deal(quotas, shards, 0, shards, 3), key=lambda x: x[0])
        assert [s for s, _, _ in whole] == list(range(shards))
        assert (sum(n for _, _, n in whole) == quotas).all()
        at = np.zeros_like(quotas)
        for s, first, n in whole:
            assert (first == at).all() and n.sum() == quotas.sum() * (s + 1) // shards - quotas.sum() * s // shards
            at = at + n
        for low in range(0, shards, 3):  # each range of shards finds the same by itself
            own = sorted(M.deal(quotas, shards, low, low + 3, 3), key=lambda x: x[0])
            assert [(s, f.tolist(), n.tolist()) for s, f, n in own] == [(s, f.tolist(), n.tolist()) for s, f, n in whole[low : low + 3]]


def test_shares_are_hypergeometric():
    quotas, got = np.array([300, 100, 200]), []
    for seed in range(2000):
        got.append(next(n for s, _, n in M.deal(quotas, 6, 0, 1, seed)))
    got = np.array(got)
    p = quotas / 600
    var = 100 * p * (1 - p) * 500 / 599
    assert np.allclose(got.mean(axis=0), 100 * p, atol=0.6) and np.allclose(got.var(axis=0), var, rtol=0.12)


@pytest.mark.parametrize("length", [1, 16, 256])
def test_mix_against_brute_force(spark, length):
    rows = corpus()
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += sizes_of(text)
    want = wanted(sizes)
    mix = M.mix(spark.createDataFrame(rows, SCHEMA).repartition(7), block_words=length, shard_draws=50, seed=4)
    found = mix.taken().collect()
    count = lambda rs: Counter((r[0], r[1]) for r in rs)
    assert count(found) == count([(i, sizes_of(t)) for i, t, _, _ in rows])
    source = {(i, sizes_of(t)): s for i, t, s, _ in rows}
    took = defaultdict(int)
    for r in found:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        took[s] += r.taken
    assert all(abs(took[s] - want[s]) <= 0.5 for s in sizes)

    spans, drawn = mix.spans().collect(), mix.drawn.collect()
    names = {r.number: r.source for r in mix.sources.collect()}
    by_doc, words = Counter(), Counter()
    for r in spans:
        by_doc[r.number, r.start] += r.n_words
        words[r.shard, r.slot] += r.n_words
        assert 0 <= r.from_word and r.n_words > 0
    assert sorted(by_doc.values()) == sorted(r.taken for r in found if r.taken)
    assert words == {(r.shard, r.slot): r.words for r in drawn}
    assert max(Counter((r.number, r.block) for r in drawn).values()) <= 2
    per_shard = Counter(r.shard for r in drawn)
    assert len(per_shard) == mix.shards and max(per_shard.values()) - min(per_shard.values()) <= 1
    assert {names[r.number] for r in drawn} == {s for s in sizes if sizes[s]}

    texts = mix.texts().collect()
    assert sum(sizes_of(r.text) for r in texts) == sum(took.values())
    whole = defaultdict(set)
    for i, t, _, _ in rows:
        whole[i].add(t)
    for r in texts:
        assert sizes_of(r.text) == r.n_words and any(r.text in " ".join((t or "").split()) for t in whole[r.doc_id])
    assert Counter((r.shard, r.slot, r.doc_id, r.from_word, r.n_words) for r in texts) == Counter((r.shard, r.slot, r.doc_id, r.from_word, r.n_words) for r in spans)


def test_same_again_however_partitioned(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    one, two = (sorted(map(str, M.mix(x, block_words=16).taken().collect())) for x in (df.coalesce(1), df.repartition(9)))
    assert one == two
    assert one != sorted(map(str, M.mix(df, block_words=16, seed=1).taken().collect()))


def test_shards_are_dealt_by_many_tasks(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), SCHEMA)
    mix = M.mix(df, block_words=4, shard_draws=20)
    assert mix.shards > 40 and len(mix.drawn.inputFiles()) > 4
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    again = M.mix(df, block_words=4, shard_draws=20)
    assert sorted(map(str, again.drawn.collect())) == sorted(map(str, mix.drawn.collect()))


def test_tables_without_words(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    assert M.mix(df.limit(0)).taken().count() == 0
    none = M.mix(df.withColumn("text", F.lit(None).cast("string")))
    assert {(r.taken, r.target) for r in none.taken().collect()} == {(0, 0.0)} and none.texts().count() == 0


def test_query_keeps_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op12_source_mix(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, took = Counter(), Counter()
    for r in docs.values():
        sizes[r.source] += sizes_of(r.text)
    want = wanted(sizes)
    for r in rows:
        s = docs[r.doc_id].source
        assert r["size"] == sizes_of(docs[r.doc_id].text) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        took[s] += r.taken
    assert len(rows) == len(docs) and all(abs(took[s] - want[s]) <= 0.5 for s in sizes)
