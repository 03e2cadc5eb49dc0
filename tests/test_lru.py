import random
from collections import OrderedDict
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.functions.dominance import dominance
from tidemark.operators import attribution, lru

SCHEMA = "event_id long, ts timestamp_ntz, folder long, size long, kind string, reward double"


def rows_of(n, folders, seed):
    rng = random.Random(seed)
    import datetime

    start, out = datetime.datetime(2024, 1, 1), []
    for i in range(n):
        f = min(rng.randrange(folders), rng.randrange(folders))
        out.append((i, start + datetime.timedelta(minutes=rng.randrange(n)), f, 1 + f % 7, "k", 1.0))
    return out


def simulate(rows, capacity, size):
    """hit by event of an LRU cache that evicts its tail until a folder fits."""
    cache, used, hits = OrderedDict(), 0, {}
    for event, _, folder, s, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        w = s if size else 1
        hits[event] = int(folder in cache)
        if w > capacity:
            continue
        if folder in cache:
            cache.move_to_end(folder)
            continue
        cache[folder] = w
        used += w
        while used > capacity:
            used -= cache.popitem(last=False)[1]
    return hits


def test_dominance_against_loops():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100):
        value, weight = rng.integers(0, 50, n), rng.integers(1, 9, n)
        low, high, bound = rng.integers(0, n + 1, 60), rng.integers(0, n + 1, 60), rng.integers(-1, 60, 60)
        want = [sum(weight[i] for i in range(a, b) if value[i] < c) for a, b, c in zip(low, high, bound, strict=True)]
        assert dominance(value, weight, low, high, bound).tolist() == want


@pytest.mark.parametrize("block", [16, 100, 65536])
def test_depths_against_simulation(spark, block, monkeypatch):
    monkeypatch.setattr(lru, "FEW", 8)
    rows = rows_of(700, 40, block)
    df = spark.createDataFrame(rows, SCHEMA)
    deep = lru.depths(df, block=block).cache()
    last = 0
    for capacity in (1, 5, 20, 60):
        got = {r.event_id: r.hit for r in lru.hits(deep, capacity).collect()}
        assert got == simulate(rows, capacity, False)
        assert sum(got.values()) >= last  # more capacity never loses hits
        last = sum(got.values())
    for capacity in (5, 30):
        assert {r.event_id: r.hit for r in lru.sized(df, capacity, block).collect()} == simulate(rows, capacity, True)
    says = attribution.classed(deep, 20).groupBy("class").count().collect()
    counts = {r["class"]: r["count"] for r in says}
    assert sum(counts.values()) == 700 and counts["cold"] == len({r[2] for r in rows})


def test_grids_of_grids(spark, monkeypatch):
    monkeypatch.setattr(lru, "STEP", 2)
    monkeypatch.setattr(lru, "FEW", 3)
    rows = rows_of(300, 25, 9)
    deep = lru.depths(spark.createDataFrame(rows, SCHEMA), block=8).cache()
    for capacity in (3, 12, 24):
        assert {r.event_id: r.hit for r in lru.hits(deep, capacity).collect()} == simulate(rows, capacity, False)


def test_empty_trace(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lru.depths(df).count() == 0 and lru.sized(df, 5).count() == 0


def drawn_trace(spark, n, folders):
    rng = np.random.default_rng(11)
    folder = (folders * rng.random(n) ** 2).astype(int)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), int(f)) for i, f in enumerate(folder)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, folder long")


def test_sampled_curve_of_all_folders_is_the_curve(spark):
    rows = drawn_trace(spark, 1500, 200)
    exact = {r.capacity: r.n_hits / r.n for r in lru.hit_curve(lru.depths(rows), [10, 50, 100]).collect()}
    got = {r.capacity: r.hit_rate for r in lru.sampled_curve(rows, [10, 50, 100], 1).collect()}
    assert got == exact


def test_sampled_curve_is_near_at_one_folder_in_a_hundred(spark):
    rows, capacities = drawn_trace(spark, 60_000, 20_000), [1000, 3000, 8000]
    exact = {r.capacity: r.n_hits / r.n for r in lru.hit_curve(lru.depths(rows), capacities).collect()}
    for r in lru.sampled_curve(rows, capacities, 100).collect():
        assert r.n_sampled < 2000 and 0 < r.error < 0.06
        assert abs(r.hit_rate - exact[r.capacity]) < 3 * r.error + 0.02


def test_sampled_curve_of_nothing(spark):
    none = drawn_trace(spark, 50, 5).filter("false")
    assert [(r.capacity, r.n_sampled, r.hit_rate, r.error) for r in lru.sampled_curve(none, [5], 4).collect()] == [(5, 0, None, None)]
