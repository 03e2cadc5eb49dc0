"""Training rows, splits, negatives, candidates and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bucket
from tidemark.operators import history
from tidemark.sources.scratch import Scratch


def split(trace: DataFrame, train_tenths: int = 8) -> DataFrame:
    return trace.withColumn("split", F.when(bucket(F.col("event_id"), 8, 10) < train_tenths, "train").otherwise("test"))


def hash_ranked(folders: DataFrame) -> DataFrame:
    """Append r, the folder's rank from 0 in order of SHA-256, counted in parts of
    the hash range so that no task sorts all folders."""
    rows = folders.withColumn("h", F.sha2(F.col("folder").cast("string"), 256)).withColumn("part", F.left("h", F.lit(3)))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("h", "folder"))
    return rows.withColumn("inside", inside).join(before, "part").select("folder", (F.col("before") + F.col("inside") - 1).alias("r"))


def negatives(trace: DataFrame, per_day: int = 5) -> DataFrame:
    """For each day the first ``per_day`` folders that it doesn't touch, going round
    the folders in hash order from a place that the day's hash gives.

    A day that touches t folders finds them among the next t + ``per_day`` places, so
    as many rows are made as there are touches: no day meets all folders."""
    touched = history.daily_demand(trace).select("day", "folder")
    ranked = hash_ranked(trace.select("folder").distinct())
    n = ranked.agg(F.count("*").alias("n_folders"))
    days = touched.groupBy("day").agg(F.count("*").alias("t")).crossJoin(F.broadcast(n))
    start = F.pmod(F.conv(F.left(F.sha2(F.col("day").cast("string"), 256), F.lit(8)), 16, 10).cast("long"), F.col("n_folders"))
    places = days.select("day", "n_folders", start.alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("t") + per_day, F.col("n_folders")) - 1)).alias("s"))
    free = places.withColumn("r", F.pmod(F.col("start") + F.col("s"), F.col("n_folders"))).join(ranked, "r").join(touched, ["day", "folder"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("day").orderBy("s"))
    return free.withColumn("rank", rank).filter(F.col("rank") <= per_day).select("day", "folder", "rank")


def training_rows(trace: DataFrame, past_hours: int, next_hours: int) -> DataFrame:
    return history.next_within(history.trailing_count(trace, past_hours), next_hours)


def actor_model(rows: DataFrame, features: list[str]) -> PipelineModel:
    """The probability of label 1, fitted on the training rows of ``split`` only. The
    model can be saved and loaded."""
    fitted = LogisticRegression(featuresCol="__x", labelCol="label", maxIter=20, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), fitted]).fit(split(rows).filter("split = 'train'"))


def act(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Append split and probability; test rows are ones that the model hasn't seen."""
    return model.transform(split(rows)).withColumn("probability", vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__y")


def fit_actor(rows: DataFrame, features: list[str]) -> DataFrame:
    return act(actor_model(rows, features), rows)


def _ranked(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(*order)))


def popular(trace: DataFrame, k: int = 20) -> DataFrame:
    """For each day the k folders with most accesses the day before: day, folder, rank."""
    demand = history.daily_demand(trace).withColumn("day", F.date_add("day", 1))
    return _ranked(demand, F.desc("n"), "folder").filter(F.col("rank") <= k).select("day", "folder", "rank")


def recent(trace: DataFrame, k: int = 20) -> DataFrame:
    """For each day the k folders touched last the day before."""
    day = F.date_add(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date"), 1)
    last = trace.groupBy(day.alias("day"), "folder").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return _ranked(last, F.desc("last"), "folder").filter(F.col("rank") <= k).select("day", "folder", "rank")


def candidates(trace: DataFrame, k: int = 20) -> DataFrame:
    return popular(trace, k).select("day", "folder").union(recent(trace, k).select("day", "folder")).distinct()


def recall(trace: DataFrame, list_: DataFrame) -> DataFrame:
    """Per day the share of touched folders that the list covers, on days with a list."""
    found = history.daily_demand(trace).join(list_.select("day", "folder").withColumn("hit", F.lit(1)), ["day", "folder"], "left")
    out = found.groupBy("day").agg(F.count("*").alias("n"), F.count("hit").alias("n_found"))
    return out.join(list_.select("day").distinct(), "day", "left_semi").withColumn("recall", F.col("n_found") / F.col("n").cast("double"))


def ranking_quality(trace: DataFrame, list_: DataFrame) -> DataFrame:
    """Per day the reciprocal rank of the first folder found, and the DCG of all."""
    found = history.daily_demand(trace).join(list_, ["day", "folder"])
    return found.groupBy("day").agg(F.round(1 / F.min("rank"), 4).alias("reciprocal_rank"), F.round(F.sum(1 / F.log2(F.col("rank") + 1)), 4).alias("dcg"))


def actor_ranks(model: PipelineModel, trace: DataFrame, past_hours: int = 24, k: int = 20) -> DataFrame:
    """For each day the actor's k best of its candidates: day, folder, rank. The actor
    sees each candidate as it was at its last access of the day before."""
    day = F.date_add(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date"), 1)
    rows = history.trailing_count(trace, past_hours)
    last = rows.groupBy(day.alias("day"), "folder").agg(F.max_by(F.struct("n_recent", "reward"), F.struct("ts", "event_id")).alias("x"))
    seen = candidates(trace, k).join(last, ["day", "folder"]).select("day", "folder", "x.n_recent", "x.reward")
    scored = model.transform(seen).withColumn("probability", vector_to_array("__p")[1])
    return _ranked(scored, F.desc("probability"), "folder").filter(F.col("rank") <= k).select("day", "folder", "rank")


def actor_quality(model: PipelineModel, trace: DataFrame, k: int = 20) -> DataFrame:
    """Recall, reciprocal rank and DCG of the actor's own ranks by day; a day on which it
    found nothing has zeros."""
    cut = Scratch(trace.sparkSession).cut(actor_ranks(model, trace, k=k))
    quality = ranking_quality(trace, cut)
    out = recall(trace, cut).join(quality, "day", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("reciprocal_rank", "dcg")})


def ablation(trace: DataFrame, k: int = 20) -> DataFrame:
    """Folders found by each candidate list alone, and what it lacks against both."""
    demand = history.daily_demand(trace).select("day", "folder")
    lists = {"popular": popular(trace, k), "recent": recent(trace, k), "union": candidates(trace, k)}
    counts = None
    for name, rows in lists.items():
        one = demand.join(rows.select("day", "folder"), ["day", "folder"], "left_semi").agg(F.lit(name).alias("list"), F.count("*").alias("n_found"))
        counts = one if counts is None else counts.unionByName(one)
    whole = counts.filter("list = 'union'").select(F.col("n_found").alias("all"))
    return counts.crossJoin(whole).select("list", "n_found", (F.col("n_found") - F.col("all")).alias("delta"))
