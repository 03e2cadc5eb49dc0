"""Intervals by the Poisson bootstrap, in one pass and the same on every run.

In each replicate a unit counts as often as a Poisson number with mean 1 says. The
number comes from a hash of the unit's name and the replicate, so no unit must know how
many others there are, two measures of one unit are weighed alike, and any engine
gives the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of 32 bits that one SHA-256 gives.
PER_HASH = 8


def thresholds(most: int = 10) -> list[int]:
    """A 32-bit number counts as many times as it reaches one of these: a Poisson number of mean 1."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(math.floor(total * 2**32))
    return out


def weights(unit: Column, group: Column) -> Column:
    """Array of the weights of eight replicates of a unit."""
    h = F.sha2(F.concat_ws(":", unit, group.cast("string")), 256)
    number = lambda j: F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("long")
    return F.array(*[sum((number(j) >= t).cast("long") for t in thresholds()) for j in range(PER_HASH)])


def replicates(units: DataFrame, name: Column, values: list[str], times: int = 200) -> DataFrame:
    """(replicate, and each value's weighed sum) of ``units``; replicates no unit is in have sums of 0.

    Every unit is hashed times / 8 times; the sums are made before anything is shuffled,
    so ``times`` rows a task are all that moves."""
    groups = -(-times // PER_HASH)
    rows = units.select(name.alias("__unit"), *values).select(*values, "__unit", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__group"))
    each = weights(F.col("__unit"), F.col("__group"))
    sums = [F.sum(F.col(v) * F.col("__w")[j]).alias(f"{v}_{j}") for v in values for j in range(PER_HASH)]
    rows = rows.select(*values, "__group", each.alias("__w")).groupBy("__group").agg(*sums)
    apart = F.explode(F.array(*[F.struct((F.col("__group") * PER_HASH + j).alias("replicate"), *[F.col(f"{v}_{j}").alias(v) for v in values]) for j in range(PER_HASH)]))
    return rows.select(apart.alias("x")).select("x.*").filter(F.col("replicate") < times)


def intervals(made: DataFrame, values: list[str], tail: float = 0.025) -> DataFrame:
    """(value's name, low, high): of each value's replicates in order the one with so large a
    part below it, and the one with so large a part above."""
    long = made.select(F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).alias("x"), F.col("replicate")) for v in values])).alias("e")).select("e.*")
    order = Window.partitionBy("name").orderBy("x", "replicate")
    long = long.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("name"))})
    cut = F.floor(F.col("n") * F.lit(tail))
    return long.groupBy("name").agg(F.max(F.when(F.col("i") == cut, F.col("x"))).alias("low"), F.max(F.when(F.col("i") == F.col("n") - 1 - cut, F.col("x"))).alias("high"))


def ablation_intervals(demand: DataFrame, lists: dict[str, DataFrame], whole: str, times: int = 200) -> DataFrame:
    """What each list finds less than ``whole`` of the (day, folder) pairs of ``demand``: list,
    n_found, delta, low and high. Both lists are weighed alike for each pair."""
    hits = demand.select("day", "folder")
    for name, rows in lists.items():
        hits = hits.join(rows.select("day", "folder").distinct().withColumn(f"hit_{name}", F.lit(1).cast("long")), ["day", "folder"], "left")
    found = {n: F.coalesce(f"hit_{n}", F.lit(0).cast("long")) for n in lists}
    units = hits.select(F.concat_ws(":", F.col("day").cast("string"), F.col("folder").cast("string")).alias("unit"), *[found[n].alias(n) for n in lists], *[(found[n] - found[whole]).alias(f"d_{n}") for n in lists])
    deltas = [f"d_{n}" for n in lists]
    told = intervals(replicates(units, F.col("unit"), deltas, times), deltas).select(F.substring("name", 3, 100).alias("list"), "low", "high")
    sums = units.agg(*[F.sum(c).alias(c) for c in (*lists, *deltas)])
    sums = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("n_found"), F.col(f"d_{n}").alias("delta")) for n in lists])).alias("e")).select("e.*")
    return sums.join(told, "list")
