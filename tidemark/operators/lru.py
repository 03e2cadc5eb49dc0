"""LRU caches as set-oriented queries.

An access hits in a cache of some capacity if and only if its folder and the
distinct folders touched since its last access fit in it (Mattson et al. 1970).
That sum, the depth, is computed once and answers every capacity. The first touch
of a folder after a time is the access whose own last access lies before it, so a
depth is a dominance sum over places and last places.

The sum is taken in blocks of places: within a block's own accesses, within the
accesses whose last place lies in a block, and over whole blocks between by a grid
of counts, which is summed in blocks in its turn. A task holds two blocks' rows, or
the cells of STEP rows of a grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bucket
from tidemark.functions.dominance import dominance

#: Places of a block; blocks of a block of the grids above; places that one task takes.
BLOCK, STEP, FEW = 65_536, 16, 1024
PARTS = "lo long, hi long, part long"


def placed(trace: DataFrame, span: int = 3600) -> DataFrame:
    """Append pos (1 for the first access in order of ts, event_id) and prev (the
    folder's last pos before, or null).

    Places are counted within spans of so many seconds, and what lies in earlier
    spans is added: no task sorts more than a span.
    """
    part = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (span * 1_000_000))
    rows = trace.withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = rows.withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy("ts", "event_id"))).join(before, "part")
    rows = rows.withColumn("pos", (F.col("before") + F.col("inside")).cast("long")).drop("part", "inside", "before")
    return rows.withColumn("prev", F.lag("pos").over(Window.partitionBy("folder").orderBy("pos")))


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a block's points add to each of its asks."""
    p = pdf[pdf.ask == 0].sort_values("p")
    q = pdf[pdf.ask == 1]
    at, lo, hi = p.p.to_numpy(), q.q.to_numpy(), q.p.to_numpy()
    low, high = np.searchsorted(at, lo, side="right"), np.searchsorted(at, hi, side="left")
    return pd.DataFrame({"lo": lo, "hi": hi, "part": dominance(p.q.to_numpy(), p.w.to_numpy(), low, np.maximum(low, high), lo)})


def _dominated(points: DataFrame, asks: DataFrame, places: int, block: int) -> DataFrame:
    """Parts (lo, hi, part) whose sum by ask (lo, hi) is the weight w of the points
    (p, q, w) with lo < p < hi and q < lo; -1 <= q < p < places.

    Whole blocks between are points again, of a grid of blocks, so they are answered
    in the same way until few blocks are left. A level has at most as many points as
    the one before it.
    """
    point = points.select("p", "q", "w", F.lit(0).alias("ask"))
    ask = asks.select(F.col("hi").alias("p"), F.col("lo").alias("q"), F.lit(0).cast("long").alias("w"), F.lit(1).alias("ask"))
    if places <= FEW:
        return point.unionByName(ask).withColumn("b", F.lit(0)).groupBy("b").applyInPandas(_sums, PARTS)
    of = lambda c: F.floor(F.col(c) / block)
    inside = point.withColumn("b", of("p")).unionByName(ask.withColumn("b", of("p"))).unionByName(ask.withColumn("b", of("q")).filter(F.col("b") != of("p")))
    parts = inside.groupBy("b").applyInPandas(_sums, PARTS)
    if places <= block:
        return parts
    # points of later blocks whose last place lies in the block where the ask begins

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[pdf.ask == 0].assign(k=lambda d: d.p // block).sort_values("k")
        q = pdf[pdf.ask == 1]
        at, lo, hi = p.k.to_numpy(), q.q.to_numpy(), q.p.to_numpy()
        low, high = np.searchsorted(at, lo // block, side="right"), np.searchsorted(at, hi // block, side="left")
        return pd.DataFrame({"lo": lo, "hi": hi, "part": dominance(p.q.to_numpy(), p.w.to_numpy(), low, np.maximum(low, high), lo)})

    apart = of("p") > of("q")
    starts = point.filter(apart & (F.col("q") >= 0)).unionByName(ask.filter(of("p") > of("q") + 1)).withColumn("b", of("q"))
    parts = parts.unionByName(starts.groupBy("b").applyInPandas(between, PARTS))
    if places <= 2 * block:  # no whole block between
        return parts
    grid = points.groupBy(of("p").alias("p"), of("q").alias("q")).agg(F.sum("w").alias("w"))
    far = asks.select("lo", "hi", of("lo").alias("i"), of("hi").alias("j")).filter("j > i + 1")
    whole = _dominated(grid, far.select(F.col("i").alias("lo"), F.col("j").alias("hi")).distinct(), -(-places // block), STEP)
    whole = whole.groupBy(F.col("lo").alias("i"), F.col("hi").alias("j")).agg(F.sum("part").alias("part")).filter("part > 0")
    return parts.unionByName(far.join(whole, ["i", "j"]).select("lo", "hi", "part"))


def depths(trace: DataFrame, weight: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``placed(trace)`` with depth: the weight of the folder and of the distinct
    folders since its last access; null for a folder's first access.

    ``weight``: a folder's size, constant over the trace; 1 if not given.
    """
    w = (F.lit(1) if weight is None else weight).cast("long")
    rows = placed(trace).withColumn("w", w)
    zero = F.lit(-1).cast("long")
    points = rows.select((F.col("pos") - 1).alias("p"), F.coalesce(F.col("prev") - 1, zero).alias("q"), "w")
    asks = points.filter("q >= 0").select(F.col("q").alias("lo"), F.col("p").alias("hi"))
    parts = _dominated(points, asks, trace.count(), block).select((F.col("hi") + 1).alias("pos"), "part")
    depth = parts.groupBy("pos").agg(F.sum("part").alias("between"))
    out = rows.join(depth, "pos", "left")
    return out.withColumn("depth", F.when(F.col("prev").isNotNull(), F.coalesce("between", F.lit(0)) + F.col("w"))).drop("between", "w")


def hits(deep: DataFrame, capacity: int) -> DataFrame:
    """Append hit (0 or 1) for a capacity."""
    return deep.withColumn("hit", F.when(F.col("depth") <= capacity, 1).otherwise(0))


def hit_curve(deep: DataFrame, capacities: list[int]) -> DataFrame:
    """capacity, n_hits, n: all capacities from one pass over the depths."""
    one = deep.agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("depth") <= c, 1).otherwise(0)).alias(f"c{c}") for c in capacities])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("capacity"), F.col(f"c{c}").cast("long").alias("n_hits"), F.col("n").alias("n")) for c in capacities])))


def sampled_curve(trace: DataFrame, capacities: list[int], buckets: int, groups: int = 16, block: int = BLOCK) -> DataFrame:
    """capacity, n_sampled, hit_rate, error: the hit curve from the accesses of one folder in ``buckets``.

    Folders are drawn by their hash, so a drawn one has all its accesses, and the
    distinct folders between two of them are about as many times those drawn as the
    trace has folders for each drawn one (Waldspurger et al. 2015, who scale by the
    nominal share: with few folders that is far off). An access's folder itself
    counts once and is not scaled. With one bucket the rate is exact. ``error`` is the
    standard error of the rate over ``groups`` groups of drawn folders, taken as
    independent; the noise of the scaled depths (about the root of buckets times
    capacity, in folders) comes on top. A sample without accesses gives nulls. Null
    folders are never drawn. Only distinct folders and the sample are shuffled.
    """
    spot = bucket(F.col("folder"), 8, buckets * groups)
    drawn = trace.withColumn("group", spot).filter(F.col("group") % buckets == 0)
    deep = depths(drawn, block=block)
    folders = trace.select("folder").filter("folder is not null").distinct()
    seen = folders.agg(F.count("*").alias("all"), F.count_if(spot % buckets == 0).alias("drawn")).first()
    far = (F.col("depth") - 1) * F.lit(seen["all"] / max(seen["drawn"], 1)) + 1
    by_group = deep.groupBy("group").agg(F.count("*").alias("n"), *[F.sum(F.when(far <= c, 1).otherwise(0)).alias(f"c{c}") for c in capacities])
    sums = [F.struct(F.lit(c).cast("long").alias("capacity"), F.col(f"c{c}").cast("double").alias("h"), F.col("n").cast("double").alias("n")) for c in capacities]
    blank = trace.sparkSession.createDataFrame([(c, 0.0, 0.0) for c in capacities], "capacity long, h double, n double")
    total = by_group.select(F.inline(F.array(*sums))).union(blank).groupBy("capacity")
    total = total.agg(*[F.sum(x).alias(name) for name, x in {"h": F.col("h"), "n": F.col("n"), "hh": F.col("h") * F.col("h"), "hn": F.col("h") * F.col("n"), "nn": F.col("n") * F.col("n")}.items()])
    rate = F.when(F.col("n") > 0, F.col("h") / F.col("n"))
    spread = F.greatest(F.lit(0.0), F.col("hh") - 2 * rate * F.col("hn") + rate * rate * F.col("nn"))
    return total.select("capacity", F.col("n").cast("long").alias("n_sampled"), rate.alias("hit_rate"), F.when(F.col("n") > 0, F.sqrt(F.lit(groups / (groups - 1)) * spread) / F.col("n")).alias("error"))


def sized(trace: DataFrame, capacity: int, block: int = BLOCK) -> DataFrame:
    """Accesses with hit for a cache of ``capacity`` units of folder size. Folders
    larger than it bypass the cache: they miss and displace nothing."""
    deep = hits(depths(trace.filter(F.col("size") <= capacity), F.col("size"), block), capacity)
    large = trace.filter(F.col("size") > capacity).withColumns({"pos": F.lit(None).cast("long"), "prev": F.lit(None).cast("long"), "depth": F.lit(None).cast("long"), "hit": F.lit(0)})
    return deep.unionByName(large.select(*deep.columns))
