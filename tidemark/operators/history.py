"""What a folder's recent past says: features and labels of each access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import seconds


def by_time() -> WindowSpec:
    return Window.partitionBy("folder").orderBy("ts", "event_id")


def micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def trailing_count(trace: DataFrame, hours: int) -> DataFrame:
    """Accesses of the folder in the hours up to and with this one."""
    near = Window.partitionBy("folder").orderBy(micros()).rangeBetween(-hours * 3_600_000_000, 0)
    return trace.withColumn("n_recent", F.count("*").over(near))


def since_last(trace: DataFrame) -> DataFrame:
    """Microseconds since the folder's last access."""
    return trace.withColumn("gap_us", micros() - F.lag(micros()).over(by_time()))


def daily_demand(trace: DataFrame) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date")
    return trace.groupBy(day.alias("day"), "folder").agg(F.count("*").alias("n"))


def last_kinds(trace: DataFrame, k: int = 3) -> DataFrame:
    """Kinds of the folder's k accesses before, oldest first, joined by commas."""
    return trace.withColumn("last_kinds", F.concat_ws(",", F.collect_list("kind").over(by_time().rowsBetween(-k, -1))))


def decayed(trace: DataFrame) -> DataFrame:
    """Sum of exp(-days since) over the folder's earlier accesses.

    exp(-(t - s)) is exp(-t) times exp(s), so running sums do; days are counted from
    the folder's first access and the past is summed in blocks of 256 days, so that
    no power leaves the range of doubles. One window, no self-join."""
    days = (micros() - F.min(micros()).over(Window.partitionBy("folder"))) / 86_400_000_000
    rows = trace.withColumn("t", days).withColumn("b", F.floor(F.col("t") / 256))
    rows = rows.withColumn("u", F.col("t") - 256 * F.col("b"))
    inside = Window.partitionBy("folder", "b").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("folder", "b").agg(F.sum(F.exp(F.col("u") - 256)).alias("left")).select("folder", (F.col("b") + 1).alias("b"), "left")
    rows = rows.withColumn("own", F.coalesce(F.sum(F.exp("u")).over(inside), F.lit(0.0)) * F.exp(-F.col("u")))
    # what lies two blocks back weighs under exp(-256)
    rows = rows.join(blocks, ["folder", "b"], "left")
    return rows.withColumn("score", F.col("own") + F.coalesce("left", F.lit(0.0)) * F.exp(-F.col("u"))).drop("t", "b", "u", "own", "left")


def next_within(trace: DataFrame, hours: int) -> DataFrame:
    """label 1 where the folder's next access comes within the hours, else 0."""
    gap = seconds(F.lead("ts").over(by_time()), F.col("ts"))
    return trace.withColumn("label", F.when(gap <= hours * 3600, 1).otherwise(0))
