import os
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import company as C
from tidemark.operators import paths
from tidemark.sources.scratch import shared
from tidemark.sources.tables import trace

SF = "/root/testdata/sf0.001"


def matrix(cells):
    rows = cells.collect()
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r.a], at[r.b]] = r.w
    return names, m


def test_pairs_and_weights_against_a_loop(spark):
    seen = C.visits(trace(spark, SF), 600)
    sessions = {}
    for r in seen.collect():
        sessions.setdefault(r.session, []).append((r.place, r.path))
    want = Counter()
    for own in sessions.values():
        names = [p for _, p in sorted(own)]
        for i, a in enumerate(names):
            for b in names[i + 1 : i + 4]:
                if a != b:
                    want[a, b] += 1
                    want[b, a] += 1
    counts = C.pairs(seen, 3)
    assert {(r.a, r.b): r.n for r in counts.collect()} == want
    margin, total = Counter(), sum(want.values())
    for (a, _), n in want.items():
        margin[a] += n
    w = {k: np.log(n * total / (margin[k[0]] * margin[k[1]])) for k, n in want.items()}
    got = {(r.a, r.b): r.w for r in C.weighed(counts).collect()}
    assert got.keys() == {k for k, x in w.items() if x > 0} and all(abs(got[k] - w[k]) < 1e-12 for k in got)


def test_directions_are_those_of_numpy(spark):
    cells = C.weighed(C.pairs(C.visits(trace(spark, SF), 600)))
    names, m = matrix(cells)
    u, s, _ = np.linalg.svd(m)
    block, values = C.directions(cells, k=6, spare=20, rounds=6)
    assert np.allclose(values, s[:6], rtol=5e-3)
    got = {r.path: r.y for r in block.collect()}
    y = np.array([got[n] for n in names])
    assert np.allclose(y.T @ y, np.eye(6), atol=1e-8)
    # what they span, as single vectors of nearly equal values could turn
    assert np.linalg.norm(m - y @ y.T @ m) <= 1.01 * np.linalg.norm(m - u[:, :6] @ u[:, :6].T @ m)


def test_a_matrix_of_small_rank_and_an_empty_one(spark):
    x = np.random.default_rng(2).normal(size=(12, 2))
    m = x @ x.T
    cells = spark.createDataFrame([(f"p{i}", f"p{j}", float(m[i, j])) for i in range(12) for j in range(12)], "a string, b string, w double")
    block, values = C.directions(cells, k=4, spare=4)
    assert np.allclose(values[:2], np.linalg.svd(m)[1][:2]) and np.allclose(values[2:], 0, atol=1e-5)
    assert block.count() == 12
    assert C.directions(cells.limit(0), k=2, spare=2)[0].count() == 0


def test_a_block_in_parts_and_spans_gives_the_same_directions(spark, monkeypatch):
    cells = C.weighed(C.pairs(C.visits(trace(spark, SF), 600)))
    want, values = C.directions(cells, k=4, spare=6)
    for name, few in (("SPAN_BYTES", 1 << 10), ("PACK", 500), ("PIECE", 7), ("STEP", 5)):
        monkeypatch.setattr(C, name, few)
    got, again = C.directions(cells, k=4, spare=6)
    want, got = ({r.path: r.y for r in x.collect()} for x in (want, got))
    assert got.keys() == want.keys() and np.allclose(values, again)
    a, b = (np.array([x[n] for n in sorted(want)]) for x in (want, got))
    assert np.allclose(np.abs(a.T @ b), np.eye(4), atol=1e-8)


def test_cells_of_numbers_are_those_of_paths(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.choice([None, *"abcdefghij"])) for s in range(30) for i in range(rng.randrange(12))]
    seen = spark.createDataFrame(rows, "session long, place int, path string")
    counts = C.pairs(seen, 3)
    margins = C.margins(seen, 3)
    assert {r.path: r.m for r in margins.filter("m > 0").collect()} == {r.a: r.m for r in counts.groupBy("a").agg(F.sum("n").alias("m")).collect()}
    names = margins.withColumn("number", F.ascii("path").cast("long"))
    visited = seen.join(names, "path", "left").select("session", "place", F.struct(F.col("number").alias("i"), "m").alias("own"))
    got = {(chr(r.a), chr(r.b)): r.w for r in C.numbered_cells(visited, names, 3).collect()}
    want = {(r.a, r.b): r.w for r in C.weighed(counts).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_disk_is_given_back(spark):
    """Of the blocks only the last one stays, and no shuffle but what the driver's garbage holds from before."""

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    def tables():
        top = shared(spark).removeprefix("file:")
        return {f"{d}/{x}" for d, names, _ in os.walk(top) for x in names if "/scratch-" in d}

    seen = C.visits(trace(spark, SF), 600)
    shuffled, made = shuffles(), tables()
    vectors = C.company_vectors(seen)
    for _ in range(100):
        if not (left := shuffles() - shuffled):
            break
        time.sleep(0.1)
    assert not left
    assert len({x for x in tables() - made if not x.rsplit("/", 1)[1].startswith("_")}) == 2  # the names, the block
    assert not vectors.isEmpty()


def neighbours(vectors, k=5):
    ids = vectors.withColumn("vec_id", F.xxhash64("path")).select("vec_id", "path", "embedding")
    near = paths.nearest_in_blocks(ids.select("vec_id", "embedding"), ids.selectExpr("vec_id as query_id", "embedding as q"), k)
    name = ids.select("vec_id", F.col("path").alias("neighbour"))
    return near.join(name, "vec_id").join(ids.select(F.col("vec_id").alias("query_id"), "path"), "query_id").select("path", "neighbour")


def test_company_tells_the_next_access_better_than_names(spark):
    """Topics that no url names: sessions stay in one, so company finds the next path, words don't."""
    rng, rows = random.Random(3), []
    topics = [[f"log://host/{rng.choice('abcd')}/{rng.choice('pqrs')}/{rng.randrange(10**6)}" for _ in range(8)] for _ in range(12)]
    for s in range(400):
        topic = rng.choice(topics)
        rows += [(s, i, rng.choice(topic) if rng.random() < 0.9 else rng.choice(rng.choice(topics))) for i in range(8)]
    early = spark.createDataFrame([r for r in rows if r[0] < 300], "session long, place int, path string")
    late = spark.createDataFrame([r for r in rows if r[0] >= 300], "session long, place int, path string")
    by_company = C.next_recall(late, neighbours(C.company_vectors(early))).first()
    pages = early.select("path").distinct().select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"))
    named = paths.encoded_paths(paths.path_encoder(pages), pages).join(pages.withColumnRenamed("page_id", "vec_id"), "vec_id").select(F.col("url").alias("path"), "embedding")
    by_name = C.next_recall(late, neighbours(named)).first()
    assert by_company.n == by_name.n > 500
    assert by_company.n_found > 0.4 * by_company.n and by_company.n_found > 3 * by_name.n_found
