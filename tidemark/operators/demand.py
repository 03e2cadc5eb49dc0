"""Forecasts of intermittent demand, each day's from the days before, and how wrong they were.

A folder's days run from its first access to the log's last day, most of them without
demand. An ordered fold carries the size of a demand, the interval between demands and
the chance of one, each smoothed: Croston's forecast is size over interval, Syntetos and
Boylan's takes off half the smoothing's share of it, Teunter, Syntetos and Babai's is
size times chance, which alone falls while nothing comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import history

METHODS = ("croston", "sba", "tsb")


def series(trace: DataFrame) -> DataFrame:
    """(folder, first, counts): each folder's accesses of every day from its first to the
    log's last; one array entry a day, however many accesses. Null folders are one folder."""
    demand = history.daily_demand(trace).filter(F.col("day").isNotNull())
    last = demand.agg(F.max("day").alias("last"))
    by = demand.groupBy("folder").agg(F.min("day").alias("first"), F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("on"))
    by = by.crossJoin(F.broadcast(last))  # one row
    days = F.sequence(F.lit(0), F.datediff("last", "first"))
    return by.select("folder", "first", F.transform(days, lambda i: F.coalesce(F.try_element_at("on", F.date_add("first", i)), F.lit(0).cast("long"))).alias("counts"))


def forecasts(trace: DataFrame, size: float = 0.2, chance: float = 0.1) -> DataFrame:
    """folder, day, n and a forecast by each method for every day after a folder's first.

    ``size`` smooths sizes and intervals, ``chance`` the chance of a demand. The fold
    begins at the first day's demand, an interval of one day and a chance of one."""
    number = lambda x: F.lit(x).cast("double")

    def step(s, y):
        n, met = y.cast("double"), y > 0
        gone = s["gone"]
        told = F.struct((s["z"] / s["x"]).alias("croston"), (number(1 - size / 2) * (s["z"] / s["x"])).alias("sba"), (s["p"] * s["z"]).alias("tsb"))
        return F.struct(
            F.when(met, s["z"] + number(size) * (n - s["z"])).otherwise(s["z"]).alias("z"),
            F.when(met, s["x"] + number(size) * (gone - s["x"])).otherwise(s["x"]).alias("x"),
            (s["p"] + number(chance) * (F.when(met, number(1)).otherwise(number(0)) - s["p"])).alias("p"),
            F.when(met, number(1)).otherwise(gone + 1).alias("gone"),
            F.array_append(s["told"], told).alias("told"),
        )

    none = F.array().cast("array<struct<croston:double,sba:double,tsb:double>>")
    begin = F.struct(F.col("counts")[0].cast("double").alias("z"), number(1).alias("x"), number(1).alias("p"), number(1).alias("gone"), none.alias("told"))
    rest = F.slice("counts", 2, F.greatest(F.size("counts") - 1, F.lit(0)))
    folded = series(trace).select("folder", "first", rest.alias("rest"), F.aggregate(rest, begin, step, lambda s: s["told"]).alias("told"))
    out = folded.select("folder", "first", F.posexplode(F.arrays_zip("rest", "told")).alias("i", "x"))
    return out.select("folder", F.date_add("first", F.col("i") + 1).alias("day"), F.col("x.rest").alias("n"), *[F.col(f"x.told.{m}").alias(m) for m in METHODS])


def errors(told: DataFrame, warm: int = 3) -> DataFrame:
    """Backtest with a rolling origin: method, n, mean absolute and root mean square error and
    bias of each method, of the mean of the three days before (mean3) and of the day
    before (naive), over the same days: those with ``warm`` days before them."""
    order = Window.partitionBy("folder").orderBy("day")
    rows = told.withColumn("before", F.row_number().over(order))
    rows = rows.withColumns({"mean3": F.sum("n").over(order.rowsBetween(-3, -1)) / 3.0, "naive": F.lag("n").over(order).cast("double")}).filter(F.col("before") > warm)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), (F.col(m) - F.col("n")).alias("e")) for m in (*METHODS, "mean3", "naive")]))
    rows = rows.select(each.alias("x")).select("x.*")
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))
