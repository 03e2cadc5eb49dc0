"""Sessions and demand of a growing access log, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.tables import LOG
from tidemark.streaming.ordered import ended


def arrivals(spark: SparkSession, folder: str, late: str = "2 hours", files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder, with event time ``at`` and a bound
    on how late an access may come."""
    rows = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Accesses of a folder with pauses under ``gap``: one row per session."""
    grouped = rows.groupBy(F.session_window("at", gap).alias("w"), F.col("user_id").alias("folder"))
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("reward")).select("folder", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "reward")


def demand(rows: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Accesses of each folder in tumbling, or with ``slide`` sliding, windows."""
    grouped = rows.groupBy(F.window("at", width, slide or width).alias("w"), F.col("user_id").alias("folder"))
    return grouped.agg(F.count("*").alias("n")).select("folder", F.col("w.start").alias("start"), "n")


def to_folder(rows: DataFrame, out: str, checkpoint: str, quiet: bool = False) -> StreamingQuery:
    """Append finished windows as Parquet; handles all that has arrived, then ends."""
    return ended(rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint), out, quiet)
