import pickle
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_join as N
from tidemark.llm.common import Cuts

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n, percent):
    """Components over all pairs; docs: (id or None, text), ids may repeat."""
    sets = [(k, grams(t, n)) for k, t in docs]
    root = {k: k for k, _ in sets if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((k is None, k or 0, len(s), -1 if k is None else find(k)) for k, s in sets)


def check(spark, docs, n=3, percent=75):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "component": F.lit(1), "d1": F.lit(0)})
    rows = N.ngram_components(df, n, percent).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in rows) == brute(docs, n, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 3)
    passage = [word() for _ in range(25)]
    docs = []
    for base in range(12):  # groups of near copies around bases, some with a shared passage
        words = [word() for _ in range(rng.randint(1, 60))] + (passage if base % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((rng.randrange(10**6), rng.choice(" \n").join(copy)))
    docs += [(10**7 + i, t) for i, t in enumerate([None, "", "  \n", "A b", "a B", "x", "X y Z w v"])]
    docs += [docs[0], docs[0], (None, docs[1][1]), (docs[2][0], docs[-3][1])]  # repeated, without key, a key with two texts
    check(spark, docs)
    check(spark, docs, n=2, percent=50)


def test_chain_and_hot_list(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [(i, " ".join(words[i : i + 40])) for i in range(15)]  # each like the next, ends unlike
    hot = [(100 + i, " ".join([f"u{i}", f"v{i}", *words[:5]])) for i in range(60)]  # a passage in all, none alike
    check(spark, chain + hot)


def test_empty_table_and_long_text(spark):
    assert N.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(2, "word " * 200000), (1, "word " * 7), (3, "other")], n=5)


def test_prefix_length_finds_any_similar_set():
    for n in range(1, 60):
        for m in range(1, n + 1):
            least = -(-75 * (n + m) // 175)
            if least <= m:
                assert N.prefix_length(n, 75) >= n - least + 1 and N.prefix_length(m, 75) >= m - least + 1


def test_links_of_all_classes(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 3)
    words = [word() for _ in range(40)]
    docs = [(i, " ".join(words[:i] + [word()] + words[i + 1 :])) for i in range(30)]  # near copies of one text
    docs += [(100, docs[3][1].upper()), (101, None), (102, "other words"), (None, docs[1][1])]
    classes, links = N.ngram_links(spark.createDataFrame(docs, "doc_id long, text string"), 3, 75)
    sets = {k: grams(t, 3) for k, t in docs if k is not None and t}
    own = {k: min(j for j in sets if sets[j] == s) for k, s in sets.items()}
    heads = sorted(set(own.values()))
    want = {(a, b) for a in heads for b in heads if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {r.doc_id: r.class_id for r in classes.collect()} == own and own[100] == 3
    assert sorted((r.a, r.b) for r in links.collect()) == sorted(want) and len(want) > 100


def templated(docs, own, shared, spread=0, seed=9):
    """Documents of ``shared`` template words behind ``own`` words, or up to ``spread`` more, of their own."""
    rng = random.Random(seed)
    template = " ".join(f"s{i}" for i in range(shared))
    return [(i, " ".join(f"u{rng.randrange(10**8)}" for _ in range(own + rng.randint(0, spread))) + " " + template) for i in range(docs)]


def test_unlike_documents_of_one_template_do_not_meet(spark, monkeypatch):
    lists, met, checked = [], [], []
    for name, seen in (("lists", lists), ("pairs", met), ("verified", checked)):
        whole = getattr(N.Join, name)
        monkeypatch.setattr(N.Join, name, lambda self, *a, whole=whole, seen=seen: (seen.append((a[0] if a else whole(self)).count()), whole(self, *a))[1])
    # template shares of 76 to 85 %: all prefixes hold n-grams of the template
    for own, shared, spread, sizes in ((20, 84, 0, (8000,)), (26, 84, 0, (1000,)), (15, 85, 0, (1000,)), (18, 84, 8, (1000, 4000))):
        for docs in sizes:
            for seen in (lists, met, checked):
                seen.clear()
            df = spark.createDataFrame(templated(docs, own, shared, spread), "doc_id long, text string")
            assert all(N.prefix_length(own + k + shared - 4, 75) > own + k for k in range(spread + 1))
            assert N.ngram_components(df).filter("doc_id != component_id").isEmpty()
            assert sum(met) <= docs and sum(checked) <= docs, (own, shared, docs, lists, met, checked)


def test_templates_at_the_bound_against_brute_force(spark):
    rows = [(i + 100 * k, t) for k, (own, shared, spread) in enumerate([(12, 84, 5), (13, 84, 0), (2, 30, 9), (30, 9, 9)]) for i, t in templated(40, own, shared, spread, seed=k)]
    check(spark, rows, n=5)
    rng = random.Random(2)  # one rare word in all, by words
    check(spark, [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " a") for i in range(240)], n=1)


def test_list_pairs_are_those_that_the_filters_pass(spark):
    rng = random.Random(6)
    rows = [(g, i, n, rng.randrange(N.prefix_length(n, 75)), rng.randrange(3)) for g in range(4) for i in range(60) for n in [rng.randint(1, 90)]]
    df = spark.createDataFrame(rows, "gram long, doc long, n int, p int, component int")
    want = set()
    for g, a, m, p, x in rows:
        for h, b, n, q, y in rows:
            if g == h and (m, a) < (n, b) and x != y and 100 * m >= 75 * n and 175 * min(m - p, n - q) >= 75 * (m + n):
                want.add((g, a, b, p, q))
    got = N.list_pairs(df, df, 75).collect()
    assert sorted(tuple(r) for r in got) == sorted(w[1:] for w in want) and len(want) > 50


def test_frequencies_add_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(N, "FAN_IN", 3)
    docs = [(i, f"a b c d{i % 7} e{i}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc long, text string").repartition(40)
    cuts = Cuts(spark)
    hashed = cuts.cut(N._hashed(df, 2))
    want = np.zeros(N.BUCKETS, np.int64)
    for _, text in docs:
        want += np.bincount(N.bucket(N.shingles(text, 2, N.WordHashes())), minlength=N.BUCKETS)
    assert (N._total(cuts, hashed.filter("counts is not null").select("counts")) == want).all() and want.sum() == 1200


def test_each_pair_is_verified_once(spark, monkeypatch):
    seen = []
    verified = N.Join.verified
    monkeypatch.setattr(N.Join, "verified", lambda self, pairs: (seen.extend(map(tuple, pairs.collect())), verified(self, pairs))[1])
    rng = random.Random(4)
    base = [f"w{i}" for i in range(30)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(30)] = f"x{rng.randrange(40)}"
        docs.append((i, " ".join(words)))
    check(spark, docs, n=1)
    assert len(seen) == len(set(seen)) > 100


def test_suffix_bound_is_never_too_small():
    rng = random.Random(5)
    pool = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    counts = np.zeros(N.BUCKETS, np.int64)
    sets = [np.unique(np.array(rng.sample(pool.tolist(), rng.randint(20, 200)), np.uint64)) for _ in range(40)]
    for s in sets:
        counts += np.bincount(N.bucket(s), minlength=N.BUCKETS)
    order = N.Order(counts)
    flat, outlines = order.sort(np.array([len(s) for s in sets]), np.concatenate(sets))
    at = np.cumsum([0, *map(len, sets)])
    for i in range(40):
        for j in range(i):
            x, y = flat[at[i] : at[i + 1]].tolist(), flat[at[j] : at[j + 1]].tolist()
            both = set(x) & set(y)
            if not both:
                continue
            p, q = min(map(x.index, both)), min(map(y.index, both))
            assert x[p] == y[q]
            behind = lambda o, k: np.diff(np.maximum(o, k + 1), prepend=k + 1)
            assert len(both) <= 1 + np.minimum(behind(outlines[i], p), behind(outlines[j], q)).sum() <= min(len(x) - p, len(y) - q)


def test_order_is_small_and_ranks_as_wide_as_they_need_be():
    counts = np.random.default_rng(5).integers(0, 3000, N.BUCKETS)
    order = N.Order(counts)
    assert len(pickle.dumps(order)) < 3 << 20
    assert (np.unique(counts)[order.rank] == counts).all()
    wide = N.Order(np.arange(N.BUCKETS))
    assert (wide.rank == np.arange(N.BUCKETS)).all()
