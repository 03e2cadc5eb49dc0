import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import near_embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least):
    good = [(k, np.array(v, np.float32).astype(float), c) for k, v, c in rows if k is not None and c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = {}, {k: k for k, _, _ in rows if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x, c) in enumerate(good):
        for b, y, d in good[:i]:
            if c == d and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (links.get(k, 0), find(k), find(k) == k) for k, _, _ in rows if k is not None}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("x"), "v": F.lit(1), "h1": F.lit(2)})
    return E.near_vectors(df, 0.93, **more).collect()


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(int(i * 7 % 1009), (base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])).astype(np.float32).tolist(), int(i % 2)) for i in range(150)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, rows, tables=120, projections=8)}
    assert got == brute(rows, 0.93)


def test_recall_at_the_bound():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    same = (E.buckets(x, np.zeros(4000, np.int64)) == E.buckets(y, np.zeros(4000, np.int64))).any(axis=1)
    assert same.mean() >= 0.985
    met = (E.buckets(x, np.zeros(4000, np.int64)) == E.buckets(y, np.zeros(4000, np.int64))).sum(axis=1)
    assert (met >= E.SHARED[0]).mean() >= 0.985


def test_more_vectors_keep_recall_with_fewer_chance_meetings():
    assert E.fitting(0, 0.93) == E.fitting(5000, 0.93) == (E.PROJECTIONS, E.TABLES, E.SHARED[0])
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=(2, 3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y, none = 0.93 * x + np.sqrt(1 - 0.93**2) * z, np.zeros(3000, np.int64)
    projections, tables, shared = E.fitting(1_000_000, 0.93)
    assert projections > E.PROJECTIONS and tables < 4 * E.TABLES
    keys = [E.buckets(v, none, projections, tables) for v in (x, y, z)]
    assert ((keys[0] == keys[1]).sum(axis=1) >= shared).mean() >= 0.985
    assert (keys[0] == keys[2]).mean() < 2.5 / 1_000_000


def correlated(rng, n, mean):
    """Unit vectors whose cosines lie around ``mean``: a common direction and noise."""
    x = rng.normal(size=(n, 64))
    x[:, 0] = 0
    return np.concatenate([np.full((n, 1), np.sqrt(mean)), np.sqrt(1 - mean) * (x / np.linalg.norm(x, axis=1, keepdims=True))[:, 1:]], axis=1)


def shared_tables(keys):
    """How many tables each pair of rows shares."""
    met = np.zeros((len(keys), len(keys)), np.uint16)
    for column in keys.T:
        order = np.argsort(column)
        for group in np.split(order, np.flatnonzero(np.diff(column[order])) + 1):
            if len(group) > 1:
                met[np.ix_(group, group)] += 1
    return met[np.triu_indices(len(keys), 1)]


def test_correlated_vectors_are_checked_less_than_by_the_square():
    checked, meetings = {}, {}
    for n in (4000, 8000):
        x = correlated(np.random.default_rng(7), n, 0.7)
        *fitted, shared = E.fitting(n, 0.93, cosines=E.unlinked_cosines(np.zeros(E.SAMPLE, int), list(x[: E.SAMPLE]), 0.93))
        met = shared_tables(np.concatenate([E.buckets(y, np.zeros(len(y), np.int64), *fitted) for y in np.array_split(x, 8)]))
        checked[n], meetings[n] = int((met >= shared).sum()), int(met.sum())
    assert checked[4000] < 60_000 and checked[8000] < 2.5 * checked[4000]
    assert meetings[8000] < 3.5 * meetings[4000]
    # pairs at the bound among them are found as surely as elsewhere
    x = correlated(np.random.default_rng(8), 3000, 0.7)
    z = np.random.default_rng(9).normal(size=x.shape)
    z -= (x * z).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    keys = [np.concatenate([E.buckets(w, np.zeros(len(w), np.int64), *fitted) for w in np.array_split(v, 6)]) for v in (x, y)]
    assert ((keys[0] == keys[1]).sum(axis=1) >= shared).mean() >= 0.985


def test_correlated_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(10)
    x = correlated(rng, 300, 0.75)
    x = np.concatenate([x, x[:60] + rng.normal(size=(60, 64)) * 0.03])
    rows = [(i, v.astype(np.float32).tolist(), i % 2) for i, v in enumerate(x)] + [(1000, x[5].astype(np.float32).tolist(), 1)]
    want = brute(rows, 0.93)
    assert sum(n > 0 for n, _, _ in want.values()) > 50
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, rows)} == want


def test_cosines_of_a_label():
    one = [np.array([1.0, 0.0]), np.array([0.0, 2.0]), np.array([1.0, 0.01]), np.array([1.0, 0.0, 0.0])]
    at, share = E.unlinked_cosines(np.zeros(4, int), one, 0.93)
    assert np.isclose(share.sum(), 1) and (np.abs(at) < 0.02).all()  # the pair at 1 is a link; lengths don't mix
    assert E.unlinked_cosines(np.arange(4), one, 0.93) is None
    assert E.tables_for(10, 1.0, shared=3) == 3


def test_unfit_vectors_link_with_nothing(spark):
    one, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(1, one, 1), (2, one, 1), (3, [2.0, 4.0], 1), (4, one, None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (None, one, 1), (11, [1.0, 2.0, 0.0], 1), (12, [1e30, 2e30], 1), (13, [-1.0, -2.0], 1), (14, one, 2)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by.pop(None) == (0, None, False)
    assert by == brute(rows, 0.93) and by[12] == (3, 1, False)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, [1.0, 0.0], 1)] * 3 + [(4, [1.0, 0.01], 1), (9, [0.0, 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in run(spark, rows))
    assert got == [(4, 3, 4, True), (5, 3, 4, False), (5, 3, 4, False), (5, 3, 4, False), (9, 0, 9, True)]
    assert run(spark, rows[:1])[0].n_links == 0
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_of_two_labels_are_no_links(spark):
    from tidemark.llm import near_embeddings

    classes = spark.createDataFrame([(1, 5, [1.0, 2.0]), (2, 6, [1.0, 2.0]), (3, 5, [1.0, 2.1])], "node long, label long, v array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in near_embeddings._exact(pairs, classes, 0.93).collect()] == [(1, 3)]
