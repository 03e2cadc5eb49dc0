import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids as C
from tidemark.llm import queries

SCHEMA = "vec_id long, embedding array<double>, CLUSTER string"


def brute(rows, k=16, rounds=3, scale=64, dimensions=64):
    """All distances in Python's whole numbers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {}
    for _, j, d in found:
        sums[j] = sums.get(j, 0) + d
    return [(i, j, d, sums[j], sum(sums.values())) for i, j, d in found], cents


def held(spark, rows, **given):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(5)
    near, cents = C.cluster(df, **given)
    want, centres = brute(rows, **given)
    assert sorted(map(tuple, near.collect()), key=str) == sorted(want, key=str)
    assert cents.tolist() == centres
    return near


def test_against_all_distances(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * 3).tolist()) for i in range(300)]
    rows += [(i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in range(300, 600)]  # ties
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (900, None), (901, [1.0] * 5), (902, [1.0, None] + [0.0] * 4), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [])]
    held(spark, rows, dimensions=6)
    held(spark, rows, dimensions=6, k=3, rounds=0, scale=1)
    held(spark, rows[:4], dimensions=6)
    held(spark, [(i, [1.5] * 6) for i in range(40)], dimensions=6)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    held(spark, [(i, (rng.normal(size=4) * 2e6).tolist()) for i in range(60)], dimensions=4, k=5)
    huge = spark.createDataFrame([(i, [1e300 * (i - 5), 1.0, 2.0, 3.0], "") for i in range(11)], SCHEMA)
    near, _ = C.cluster(huge, dimensions=4, k=2)
    rows = near.collect()
    assert len(rows) == 11 and any(r.distance is None for r in rows) and all(r.inertia is None for r in rows)


def test_nothing_kept(spark):
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, ""), (2, [1.0], "")], SCHEMA)):
        near, cents = C.cluster(df)
        assert near.count() == 0 and cents.shape == (0, 64) and near.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(6)
    centres = rng.integers(-2000, 2000, (16, 64))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-60, 61, (3000, 64))
    at, best, exact = C.assign(x, centres)
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (d.argmin(axis=1) == at).all() and (d.min(axis=1) == best).all()
    assert exact <= 1.1 * len(x)  # of 16 a vector
    noise = rng.integers(-30, 31, (3000, 64))  # nothing to tell apart: the bounds spare nothing, the result is the same
    at, best, exact = C.assign(noise, noise[:16])
    d = ((noise[:, None] - noise[None, :16]) ** 2).sum(axis=2)
    assert (d.argmin(axis=1) == at).all() and (d.min(axis=1) == best).all() and exact <= 16 * len(noise)


def test_query_matches_sql(spark):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    df = queries.op13_centroids(spark, sf)
    cur = con.execute(queries.ORACLE["op13_centroids"])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())


def test_query_without_rows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op13_centroids(spark, str(tmp_path)).count() == 0


def test_ids_of_other_kinds(spark):
    df = spark.createDataFrame([(i, [float(i)] * 64) for i in range(20)], "vec_id int, embedding array<float>")
    assert C.cluster(df)[0].count() == 20
    with pytest.raises(Exception, match="(?i)column"):
        C.cluster(df, vector="nothing")[0].count()
