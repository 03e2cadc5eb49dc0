"""Reading tables and access logs, and the binding of columns to trace concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import log_source

#: An access log: who (the folder) was touched when, of what kind, worth how much.
LOG = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
FORMATS = ("parquet", "csv", "json", "orc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def access_log(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A log with the schema given, never inferred; input is only read."""
    if kind not in FORMATS:
        raise ValueError(f"{kind}: one of {', '.join(FORMATS)}")
    reader = spark.read.schema(LOG)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)


def raw_log(spark: SparkSession, given: str, stream: bool = False, push_filters: bool = False) -> DataFrame | None:
    """A raw log named as ``kind:path`` (csv, json, orc, parquet), by the log source; None for
    anything else, such as a folder of tables."""
    kind, colon, path = given.partition(":")
    if not colon or kind not in FORMATS:
        return None
    log_source.register(spark)
    return (spark.readStream if stream else spark.read).format(log_source.NAME).option("kind", kind).option("pushFilters", push_filters).load(path)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses (event_id, ts, folder, size, kind, reward) of a folder of tables, or of a
    raw log named as ``kind:path``. A folder's size is a stand-in: 1 to 7 by its number."""
    e = raw_log(spark, sf_dir)
    e = table(spark, sf_dir, "events") if e is None else e
    return e.select(
        "event_id", "ts", F.col("user_id").alias("folder"), (1 + F.pmod(F.col("user_id"), F.lit(7))).cast("long").alias("size"),
        F.col("event_type").alias("kind"), F.col("value").alias("reward"),
    )
