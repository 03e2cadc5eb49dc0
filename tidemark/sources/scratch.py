"""Intermediate tables and models in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a session that has ended can't
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


class Scratch:
    """A folder of its own below the shared one, which goes when the process ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{shared(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.at: dict[DataFrame, str] = {}
        atexit.register(_delete, spark, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write a table and read it again, so that its lineage ends there."""
        self.made += 1
        df.write.parquet(path := f"{self.root}/{self.made}")
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[out] = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete a table that ``cut`` returned and that nothing reads any more."""
        _delete(self.spark, self.at.pop(table))
