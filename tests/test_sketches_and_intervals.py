import hashlib
import math
from collections import Counter
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, history, sketches, supervised
from tidemark.sources.tables import trace

SF = "/root/testdata/sf0.01"


def exact(rows, first, last):
    day = F.to_date("ts")
    rows = rows.filter((day >= F.lit(first)) & (day <= F.lit(last)))
    return {r.kind: r for r in rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("folder").alias("folders"), F.collect_list("reward").alias("rewards")).collect()}


def test_days_add_up_to_any_range(spark, tmp_path):
    rows, path = trace(spark, SF), f"{tmp_path}/days"
    sketches.store(sketches.daily(rows), path)
    days = sketches.stored(spark, path)
    assert days.select("day").distinct().count() == 30
    for first, last in ((date(2024, 1, 1), date(2024, 1, 30)), (date(2024, 1, 10), date(2024, 1, 16)), (date(2024, 1, 3), date(2024, 1, 3))):
        want = exact(rows, first, last)
        got = {r.kind: r for r in sketches.over(days, first, last).collect()}
        assert got.keys() == want.keys()
        for kind, w in want.items():
            g, x = got[kind], np.sort(w.rewards)
            assert g.n == w.n and g.least_folders <= w.folders <= g.most_folders and abs(g.folders - w.folders) <= 0.05 * w.folders + 1
            for q in sketches.QUANTILES:
                low, high = g[f"q{round(100 * q)}_least"], g[f"q{round(100 * q)}_most"]
                assert np.searchsorted(x, low, "left") / len(x) <= q <= np.searchsorted(x, high, "right") / len(x)
    plan = sketches.over(days, date(2024, 1, 10), date(2024, 1, 16))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_day_written_again_is_replaced(spark, tmp_path):
    rows, path = trace(spark, SF), f"{tmp_path}/days"
    sketches.store(sketches.daily(rows), path)
    sketches.store(sketches.daily(rows.filter(F.to_date("ts") == F.lit("2024-01-05")).limit(7)), path)
    assert sketches.stored(spark, path).filter("day = '2024-01-05'").agg(F.sum("n")).first()[0] == 7
    assert sketches.stored(spark, path).select("day").distinct().count() == 30


def test_many_folders_stay_within_the_bounds(spark):
    rows = spark.range(200_000).select(F.col("id").alias("folder"), F.timestamp_seconds(F.col("id") * 10).cast("timestamp_ntz").alias("ts"), F.lit("view").alias("kind"), (F.col("id") % 1000).cast("double").alias("reward"))
    told = sketches.over(sketches.daily(rows)).first()
    assert told.least_folders <= 200_000 <= told.most_folders and told.most_folders < 1.12 * 200_000
    assert abs(told.q50 - 500) < 40 and told.q50_least <= 500 <= told.q50_most


def test_nothing_and_nulls(spark):
    rows = trace(spark, SF)
    assert sketches.over(sketches.daily(rows.limit(0))).count() == 0
    odd = rows.limit(5).withColumns({"reward": F.lit(None).cast("double"), "folder": F.lit(None).cast("long")})
    assert all(r.folders == 0 and r.q50 is None for r in sketches.over(sketches.daily(odd)).collect())


def test_weights_are_poisson():
    limits = bootstrap.thresholds()
    u = np.random.default_rng(0).integers(0, 2**32, 200_000)
    w = sum((u >= t).astype(int) for t in limits)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert all(abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.005 for k in range(5))


def test_replicates_against_a_loop(spark):
    units = [(f"u{i}", i % 3, -i) for i in range(50)]
    df = spark.createDataFrame(units, "name string, a long, b long")
    limits = bootstrap.thresholds()
    for times in (16, 19):
        got = {r.replicate: (r.a, r.b) for r in bootstrap.replicates(df, F.col("name"), ["a", "b"], times).collect()}
        want = {}
        for k in range(times):
            w = [sum(int(hashlib.sha256(f"{n}:{k // 8}".encode()).hexdigest()[8 * (k % 8) :][:8], 16) >= t for t in limits) for n, _, _ in units]
            want[k] = sum(x * a for x, (_, a, _) in zip(w, units, strict=True)), sum(x * b for x, (_, _, b) in zip(w, units, strict=True))
        assert got == want


def test_intervals_cover_the_truth(spark):
    """Of 60 samples the interval of the mean's sum holds the true one about 57 times."""
    rng = np.random.default_rng(1)
    rows = [(s, i, int(x)) for s in range(60) for i, x in enumerate(rng.poisson(4, 100))]
    df = spark.createDataFrame(rows, "s long, i long, x long")
    named = df.select(F.concat_ws("-", "s", "i").alias("unit"), *[F.when(F.col("s") == s, F.col("x")).otherwise(0).alias(f"v{s}") for s in range(60)])
    values = [f"v{s}" for s in range(60)]
    told = bootstrap.intervals(bootstrap.replicates(named, F.col("unit"), values, 200), values).collect()
    assert len(told) == 60 and 50 <= sum(r.low <= 400 <= r.high for r in told)


def test_deltas_are_paired(spark):
    rows = trace(spark, SF)
    lists = {"popular": supervised.popular(rows), "again": supervised.popular(rows), "recent": supervised.recent(rows)}
    told = {r.list: r for r in bootstrap.ablation_intervals(history.daily_demand(rows), lists, "popular", 80).collect()}
    assert (told["again"].low, told["again"].delta, told["again"].high) == (0, 0, 0)  # the same list, weighed alike
    assert told["recent"].low <= told["recent"].delta <= told["recent"].high and told["recent"].low < told["recent"].high
    found = Counter((r.day, r.folder) for r in history.daily_demand(rows).join(supervised.recent(rows), ["day", "folder"]).collect())
    assert told["recent"].n_found == len(found)
