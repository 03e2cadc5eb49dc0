"""Why accesses miss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classed(deep: DataFrame, capacity: int) -> DataFrame:
    """Append class: oversize (the folder never fits), cold (first access), capacity
    (evicted since), or hit. ``deep``: accesses with size, prev and depth."""
    says = F.when(F.col("size") > capacity, "oversize").when(F.col("prev").isNull(), "cold").when(F.col("depth") > capacity, "capacity").otherwise("hit")
    return deep.withColumn("class", says)


def by_dimension(rows: DataFrame) -> DataFrame:
    """Counts by (class, kind), (class, day) and class alone, from one expansion."""
    rows = rows.select("class", "kind", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date").alias("day"))
    sets = rows.groupingSets([["class", "kind"], ["class", "day"], ["class"]], "class", "kind", "day")
    return sets.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n")).select("class", "kind", "day", "level", "n")


def worst(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k folders with most capacity misses."""
    return rows.filter("class = 'capacity'").groupBy("folder").agg(F.count("*").alias("n_misses")).orderBy(F.desc("n_misses"), "folder").limit(k)


def reuse_gaps(rows: DataFrame) -> DataFrame:
    """Histogram of the distance in places to the last access."""
    gap = F.col("pos") - F.col("prev")
    band = F.when(gap.isNull(), "none").when(gap <= 10, "upto_10").when(gap <= 100, "upto_100").otherwise("over_100")
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def hit_rate(rows: DataFrame, *by) -> DataFrame:
    """n, n_hits and hit_rate by the columns given."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("n_hits")).withColumn("hit_rate", F.col("n_hits") / F.col("n").cast("double"))


