"""Sketches of each day that add up: distinct folders and the spread of rewards over any days.

A day's accesses are read once and leave, for each kind, a HyperLogLog sketch of their
folders and a KLL sketch of their rewards. Any range of days is then answered from the
days' sketches alone, without the accesses, and with bounds on the error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of a HyperLogLog sketch's buckets, and the k of a KLL sketch: 4 KB and some 4 KB at most.
BUCKETS, K = 12, 200
QUANTILES = (0.5, 0.9, 0.99)
#: Standard errors that an estimate may be off.
SIGMAS = 3


def daily(trace: DataFrame, buckets: int = BUCKETS, k: int = K) -> DataFrame:
    """day, kind, n, n_rewards, folders and rewards: one row for each day and kind. Null
    folders and rewards are in no sketch; rows without a time belong to no day."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date")
    rows = trace.filter("ts is not null").groupBy(day.alias("day"), "kind")
    return rows.agg(F.count("*").alias("n"), F.count("reward").alias("n_rewards"), F.hll_sketch_agg("folder", F.lit(buckets)).alias("folders"), F.kll_sketch_agg_double("reward", F.lit(k)).alias("rewards"))


def store(sketches: DataFrame, path: str) -> None:
    """Write days of sketches; a day that is there already is replaced, others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rank_error(k: int = K) -> float:
    """How far a KLL quantile's rank may be off, as a share of the values: twice what holds
    with 99 % certainty, some five standard errors."""
    return 2 * 2.296 / k**0.9021


def over(sketches: DataFrame, first=None, last=None, buckets: int = BUCKETS, k: int = K) -> DataFrame:
    """For each kind over the days from ``first`` to ``last``: n, folders with least_folders and
    most_folders (three standard errors), and for each quantile q50, q90, q99 of the rewards its
    value with the values at the ranks lower and higher by the error. Only those days' files are read."""
    rows = sketches
    for bound, keep in ((first, F.col("day") >= F.lit(first)), (last, F.col("day") <= F.lit(last))):
        rows = rows if bound is None else rows.filter(keep)
    rows = rows.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("n_rewards").alias("n_rewards"), F.hll_union_agg("folders").alias("f"), F.kll_merge_agg_double("rewards").alias("r"))
    spread = SIGMAS * 1.04 / 2 ** (buckets / 2)
    estimate = F.hll_sketch_estimate("f")
    at = lambda q: F.when(F.col("n_rewards") > 0, F.kll_sketch_get_quantile_double("r", F.lit(min(max(q, 0.0), 1.0))))
    told: list[Column] = [estimate.alias("folders"), F.floor(estimate / (1 + spread)).alias("least_folders"), F.ceil(estimate / (1 - spread)).alias("most_folders")]
    for q in QUANTILES:
        name = f"q{round(100 * q)}"
        told += [at(q).alias(name), at(q - rank_error(k)).alias(f"{name}_least"), at(q + rank_error(k)).alias(f"{name}_most")]
    return rows.select("kind", "n", *told)


def held(told: DataFrame, trace: DataFrame) -> DataFrame:
    """What sketches say beside the exact counts of the accesses they stand for: kind, n,
    n_folders (exact), and whether the bounds hold for the folders and for each quantile."""
    names = [f"q{round(100 * q)}" for q in QUANTILES]
    bounds = told.select("kind", "least_folders", "most_folders", *[f"{n}_{e}" for n in names for e in ("least", "most")])
    met = trace.join(bounds, "kind")
    share = lambda c: F.count_if(c) / F.greatest(F.count("reward"), F.lit(1))
    sums = [F.count("*").alias("n"), F.count_distinct("folder").alias("n_folders"), F.first("least_folders").alias("least"), F.first("most_folders").alias("most")]
    sums += [share(F.col("reward") < F.col(f"{n}_least")).alias(f"{n}_under") for n in names] + [share(F.col("reward") <= F.col(f"{n}_most")).alias(f"{n}_upto") for n in names]
    rows = met.groupBy("kind").agg(*sums)
    within = [((F.col(f"{n}_under") <= q) & (F.col(f"{n}_upto") >= q)).alias(f"{n}_within") for n, q in zip(names, QUANTILES, strict=True)]
    return rows.select("kind", "n", "n_folders", F.col("n_folders").between(F.col("least"), F.col("most")).alias("folders_within"), *within)
