"""Access logs by the other relational operators: JSON, cubes, ranks, set operations, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import micros


def props(events: DataFrame) -> DataFrame:
    """Sum and count by event type of ``k`` in the JSON column props; text that isn't
    such JSON, and null, count as without it."""
    k = F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).try_cast("long")
    return events.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n_k"), F.sum("k").alias("sum_k"), F.count("*").alias("n"))


def cube(trace: DataFrame) -> DataFrame:
    """Accesses and rewards by kind and size, by each alone, and in all; level tells which."""
    return trace.cube("kind", "size").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.sum("reward"), 2).alias("reward"))


def demand_ranks(trace: DataFrame) -> DataFrame:
    """Each kind's folders by number of accesses: rank with gaps, without, and relative.

    Equal counts share a rank, so a kind's distinct counts are ranked and joined back:
    no task sorts all folders of a kind."""
    demand = trace.groupBy("kind", "folder").agg(F.count("*").alias("n"))
    levels = demand.groupBy("kind", "n").agg(F.count("*").alias("many"))
    by_kind = Window.partitionBy("kind").orderBy(F.desc("n"))
    levels = levels.withColumns({"rank": (F.sum("many").over(by_kind) - F.col("many") + 1).cast("long"), "dense_rank": F.row_number().over(by_kind).cast("long")})
    share = F.try_divide((F.col("rank") - 1).cast("double"), (F.sum("many").over(Window.partitionBy("kind")) - 1).cast("double"))
    levels = levels.withColumn("percent_rank", F.round(F.coalesce(share, F.lit(0.0)), 4))
    return demand.join(levels, ["kind", "n"]).select("kind", "folder", "n", "rank", "dense_rank", "percent_rank")


def folder_sets(trace: DataFrame, one: str, other: str) -> DataFrame:
    """Folders with accesses of both kinds, of the first only, and of the second only."""
    a, b = (trace.filter(F.col("kind") == k).select("folder") for k in (one, other))
    parts = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a)}
    out = [rows.select("folder", F.lit(name).alias("part")) for name, rows in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def as_of(trace: DataFrame, kind: str) -> DataFrame:
    """As-of join with the accesses of one kind: of each access the folder's last one of
    that kind before it, and its reward; null where there is none. One window over the
    folder's accesses, no join."""
    before = Window.partitionBy("folder").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == kind, F.struct("event_id", "reward")), ignorenulls=True).over(before)
    return trace.withColumn("last", last).select("event_id", F.col("last.event_id").alias("last_id"), F.col("last.reward").alias("last_reward"))


def within(trace: DataFrame, cause: str, effect: str, minutes: int) -> DataFrame:
    """Interval join: pairs of a folder's accesses of two kinds, the effect later by so
    many minutes at most. Time is cut into pieces of that length, so each access meets
    those of its own and the next piece only."""
    width = minutes * 60_000_000
    rows = trace.select("folder", "kind", "event_id", micros().alias("at")).withColumn("piece", F.floor(F.col("at") / width))
    left = rows.filter(F.col("kind") == cause).select("folder", F.col("event_id").alias("cause_id"), F.col("at").alias("from"), F.explode(F.array(F.col("piece"), F.col("piece") + 1)).alias("piece"))
    right = rows.filter(F.col("kind") == effect).select("folder", F.col("event_id").alias("effect_id"), "at", "piece")
    pairs = left.join(right, ["folder", "piece"]).filter((F.col("at") > F.col("from")) & (F.col("at") <= F.col("from") + width))
    return pairs.select("cause_id", "effect_id", (F.col("at") - F.col("from")).alias("gap_us"))


def reach(trace: DataFrame, error: float = 0.02) -> DataFrame:
    """Distinct folders of each kind, exactly and by HyperLogLog++ of that relative error."""
    return trace.groupBy("kind").agg(F.count_distinct("folder").alias("n_folders"), F.approx_count_distinct("folder", error).alias("approx_folders"))


def demand_forecast(trace: DataFrame, days: int = 3) -> DataFrame:
    """Forecast of each folder's demand of a day: the mean of its demand on the days
    before, ``days`` of them, a day without accesses counting as none; with what came."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date")
    demand = trace.groupBy("folder", day.alias("day")).agg(F.count("*").alias("n"))
    ahead = demand.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.date_add("day", k))).alias("day"), F.col("n").alias("x"))
    sums = ahead.groupBy("folder", "day").agg((F.sum("x") / F.lit(float(days))).alias("forecast"))
    return demand.join(sums, ["folder", "day"], "left").select("folder", "day", "n", F.round(F.coalesce("forecast", F.lit(0.0)), 4).alias("forecast"))
