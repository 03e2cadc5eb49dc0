"""Run directories: each experiment writes to its own and never over another's."""

from __future__ import annotations

import threading
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


#: Seconds after which a lock that nobody renews counts as abandoned.
STALE = 600.0


class Busy(RuntimeError):
    """Another writer holds the directory."""


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


@contextmanager
def writer(spark: SparkSession, root: str, stale: float = STALE):
    """The only writer below ``root`` for a while; Busy at once if there is one.

    The lock is a file made atomically in the store itself, so it holds between
    machines. It goes even when the work fails. Its holder renews it every quarter of
    ``stale`` seconds; one that nobody renewed for so long was left by a killed
    process and is taken over. Whoever renames it away first has it."""
    path, fs = _file_system(spark, f"{root}/_writer")
    fs.mkdirs(path.getParent())
    if not fs.createNewFile(path):
        if time.time() - _renewed(fs, path) <= stale:
            raise Busy(f"{root} is being written")
        aside, _ = _file_system(spark, f"{root}/_writer-{uuid.uuid4().hex}")
        if not fs.rename(path, aside) or not fs.createNewFile(path):
            raise Busy(f"{root} is being written")
        fs.delete(aside, False)
    done = threading.Event()

    def renew() -> None:
        while not done.wait(stale / 4):
            fs.setTimes(path, int(time.time() * 1000), -1)

    keeper = threading.Thread(target=renew, daemon=True)
    keeper.start()
    try:
        yield
    finally:
        done.set()
        keeper.join()
        fs.delete(path, False)


def _renewed(fs, path) -> float:
    """Time of the lock's last renewal; now if it went meanwhile, so that the caller is told Busy."""
    try:
        return fs.getFileStatus(path).getModificationTime() / 1000
    except Py4JJavaError:
        if fs.exists(path):
            raise
        return time.time()


def save(df: DataFrame, root: str, report: str, run_id: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a report as Parquet under ``root/report/run_id=...``; an error if it exists."""
    path = f"{root}/{report}/run_id={run_id}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def save_model(model: PipelineModel, root: str, name: str, run_id: str) -> str:
    """Write a fitted model under ``root/models/name/run_id=...``; an error if it exists."""
    path = f"{root}/models/{name}/run_id={run_id}"
    model.save(path)
    return path


def load_model(root: str, name: str, run_id: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/models/{name}/run_id={run_id}")


def has_model(spark: SparkSession, root: str, name: str, run_id: str) -> bool:
    path, fs = _file_system(spark, f"{root}/models/{name}/run_id={run_id}/metadata")
    return fs.exists(path)


def load(spark: SparkSession, root: str, report: str) -> DataFrame:
    """All runs of a report, with their run_id."""
    return spark.read.option("basePath", f"{root}/{report}").parquet(f"{root}/{report}")
