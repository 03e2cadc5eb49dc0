"""Transitions, returns, critics and policies."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.history import by_time


def transitions(trace: DataFrame) -> DataFrame:
    """state, reward, next_state, done (1 for a folder's last access)."""
    after = F.lead("kind").over(by_time())
    return trace.select("event_id", "folder", F.col("kind").alias("state"), "reward", after.alias("next_state"), F.when(after.isNull(), 1).otherwise(0).alias("done"))


def discounted(trace: DataFrame, rate: float = 0.9) -> DataFrame:
    """Each folder's discounted return from its first access, rounded to 4 places."""
    n = F.row_number().over(by_time())
    return trace.select("folder", (F.pow(F.lit(rate), n - 1) * F.col("reward")).alias("x")).groupBy("folder").agg(F.round(F.sum("x"), 4).alias("return"))


def three_steps(trace: DataFrame, rate: float = 0.9) -> DataFrame:
    """Reward now and of the next two accesses, discounted."""
    term = lambda k: F.coalesce(F.lead("reward", k).over(by_time()), F.lit(0.0)) * rate**k
    return trace.select("event_id", F.round(F.col("reward") + term(1) + term(2), 4).alias("return_3"))


def future_return(trace: DataFrame) -> DataFrame:
    """Append future: the next reward and 0.9 of the one after, without this one's."""
    return trace.withColumn("future", F.coalesce(F.lead("reward", 1).over(by_time()), F.lit(0.0)) + 0.9 * F.coalesce(F.lead("reward", 2).over(by_time()), F.lit(0.0)))


def critic_model(trace: DataFrame) -> PipelineModel:
    """The linear estimate of future from size and kind, a number 0 or 1 for each kind."""
    indexed = StringIndexer(inputCol="kind", outputCol="__kind", stringOrderType="alphabetAsc", handleInvalid="keep")
    stages = [indexed, OneHotEncoder(inputCol="__kind", outputCol="__one"), VectorAssembler(inputCols=["__one", "size"], outputCol="__x")]
    return Pipeline(stages=[*stages, LinearRegression(featuresCol="__x", labelCol="future", predictionCol="critic")]).fit(future_return(trace))


def criticised(model: PipelineModel, trace: DataFrame) -> DataFrame:
    """Append future and critic."""
    return model.transform(future_return(trace)).drop("__x", "__kind", "__one")


def fit_critic(trace: DataFrame) -> DataFrame:
    return criticised(critic_model(trace), trace)


def weighed(critic: PipelineModel, trace: DataFrame, action: str = "purchase", most: float = 20.0) -> DataFrame:
    """Append advantage, weight and logged: what a policy is fitted on."""
    rows = criticised(critic, trace).withColumn("advantage", F.col("future") - F.col("critic"))
    spread = rows.agg(F.stddev("advantage")).first()[0] or 1.0
    return rows.withColumns({"weight": F.least(F.exp(F.col("advantage") / spread), F.lit(most)), "logged": F.when(F.col("kind") == action, 1.0).otherwise(0.0)})


def policy_model(rows: DataFrame) -> PipelineModel:
    """Probability of the logged action, fitted with weights exp(advantage / deviation),
    capped."""
    fitted = LogisticRegression(featuresCol="__x", labelCol="logged", weightCol="weight", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y")
    return Pipeline(stages=[VectorAssembler(inputCols=["size", "reward"], outputCol="__x"), fitted]).fit(rows)


def acted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Append policy, a model's probability of the action."""
    return model.transform(rows).withColumn("policy", vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__y")


def fit_policy(trace: DataFrame, action: str = "purchase", most: float = 20.0) -> DataFrame:
    """Append policy, the probability of the action."""
    rows = weighed(critic_model(trace), trace, action, most)
    return acted(policy_model(rows), rows)


def replayed(trace: DataFrame, capacity: int, admit: float, shard: str = "kind") -> DataFrame:
    """hit of each access in an LRU cache, one for each shard, that takes in a missed
    folder only where the access's reward is over ``admit``.

    What a policy admits decides what the cache holds later, so a shard is replayed
    in order. Its rows stream through in batches; only the cache's ``capacity``
    folders stay in memory."""

    def run(batches):
        cache: OrderedDict = OrderedDict()
        now = object()
        for pdf in batches:
            hits = []
            for s, folder, reward in zip(pdf[shard], pdf.folder, pdf.reward, strict=True):
                if s != now:
                    now = s
                    cache.clear()
                hit = folder in cache
                if hit:
                    cache.move_to_end(folder)
                elif reward > admit:
                    cache[folder] = None
                    if len(cache) > capacity:
                        cache.popitem(last=False)
                hits.append(int(hit))
            yield pd.DataFrame({"event_id": pdf.event_id, "shard": pdf[shard], "hit": hits})

    rows = trace.select("event_id", "ts", shard, "folder", "reward")
    return rows.repartition(shard).sortWithinPartitions(shard, "ts", "event_id").select("event_id", shard, "folder", "reward").mapInPandas(run, "event_id long, shard string, hit int")
