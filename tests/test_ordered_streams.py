import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables
from tidemark.streaming import ordered

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def drop(spark, rows, folder, number):
    """One more file, later than those before."""
    staged = f"{folder}-staged-{number}"
    spark.createDataFrame(rows, tables.LOG).coalesce(1).write.parquet(staged)
    part = next(f for f in os.listdir(staged) if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{staged}/{part}", f"{folder}/{number:03}.parquet")
    os.utime(f"{folder}/{number:03}.parquet", (time.time() - 1000 + number,) * 2)


def run(spark, path):
    rows = spark.readStream.schema(tables.LOG).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = ordered.to_tables(ordered.in_order(rows, "2 hours", 24), f"{path}/out", f"{path}/checkpoint")
    query.awaitTermination(240)
    assert query.exception() is None


def test_disorder_and_a_restart_give_what_a_batch_gives(rocks, tmp_path):
    spark, rng = rocks, random.Random(4)
    log = sorted(tables.table(spark, SF, "events").select(*tables.LOG.names).collect(), key=lambda r: (r.ts, r.event_id))[:400]
    files = [log[i : i + 100] for i in range(0, 400, 100)]
    for a, b in zip(files, files[1:], strict=False):  # neighbours change places over each border, by less than two hours
        if (b[0].ts - a[-1].ts).total_seconds() < 3600:
            a[-1], b[0] = b[0], a[-1]
    for f in files:
        rng.shuffle(f)
    late = [log[3], log[120]]
    files[2] = [r for r in files[2] if r not in late]
    kept = [r for r in log if r not in late]
    files = [[r for r in f if r not in late] for f in files]
    files[3] += late  # days after their time
    end = log[-1]
    far = [(10**6 + k, end.ts.replace(year=end.ts.year + 1 + k), 10**6, "view", 0.0, None) for k in range(2)]
    for n, f in enumerate(files[:2]):
        drop(spark, f, f"{tmp_path}/in", n)
    run(spark, tmp_path)
    before = spark.read.parquet(f"{tmp_path}/out/ordered").count()
    assert 0 < before < 200  # some wait in the state
    for n, f in enumerate([*files[2:], far[:1], far[1:]]):
        drop(spark, f, f"{tmp_path}/in", n + 2)
    run(spark, tmp_path)
    key = lambda r: (r.folder, r.event_id, r.us, r.value, r.gap_us)
    got = [key(r) for r in spark.read.parquet(f"{tmp_path}/out/ordered").filter("folder < 1000000").collect()]
    want = [key(r) for r in ordered.gaps(spark.createDataFrame(kept, tables.LOG), 24).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(g[-1] is None for g in got) and any(g[-1] is not None for g in got)
    told = spark.read.parquet(f"{tmp_path}/out/late").collect()
    assert {r.event_id for r in told} == {r.event_id for r in late} and len(told) == 2
    run(spark, tmp_path)  # nothing new: nothing twice
    assert spark.read.parquet(f"{tmp_path}/out/ordered").filter(F.col("folder") < 10**6).count() == len(want)
