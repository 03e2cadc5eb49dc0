"""A growing log put in order, folder by folder, with the gap since each access before.

Accesses come in any order. Each waits in its folder's state until the watermark has
passed it; then the folder's accesses leave in order, each with the microseconds since
the one before it, which the state remembers across batches and restarts. A folder
that is idle for ``forget`` is forgotten by a timer, so state is kept for folders in use
only. An access that comes after the watermark has passed it can't be put in order any
more: it leaves as it is, marked late, and goes to a table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUT = "folder long, event_id long, us long, value double, gap_us long, late boolean"
WAITS = "event_id long, us long, value double"
#: What RocksDB keeps outlives a batch and is restored from the checkpoint.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """State of a folder: accesses that wait, and the time of the last that left."""

    def __init__(self, forget_us: int):
        self.forget_us = forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITS)
        self.last = handle.getValueState("last", "us long")

    def _timer(self, us: int) -> None:
        """Wake once the watermark is past a time."""
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            late = pdf["us"] < passed
            if late.any():
                yield _told(key[0], pdf[late].assign(gap_us=None, late=True))
            new = pdf[~late]
            if len(new):
                self.waiting.appendList([(int(e), int(t), None if pd.isna(v) else float(v)) for e, t, v in zip(new["event_id"], new["us"], new["value"], strict=True)])
                for us in sorted(set((-(-new["us"] // 1000)).tolist())):
                    self.handle.registerTimer(int(us))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        free = [r for r in waiting if r[1] <= passed]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for event_id, us, value in free:
            gap = None if last is None or us - last > self.forget_us else us - last
            out.append((event_id, us, value, gap))
            last = us
        if free:
            rest = [r for r in waiting if r[1] > passed]
            self.waiting.put([tuple(r) for r in rest]) if rest else self.waiting.clear()
            self.last.update((last,))
            self._timer(last + self.forget_us + 1000)
            yield _told(key[0], pd.DataFrame(out, columns=["event_id", "us", "value", "gap_us"]).assign(late=False))
        elif last is not None and last + self.forget_us < passed:
            self.last.clear()

    def close(self) -> None:
        pass


def _told(folder, pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.assign(folder=folder)[["folder", "event_id", "us", "value", "gap_us", "late"]]
    return out.astype({"event_id": "int64", "us": "int64", "gap_us": "Int64", "late": bool})


def in_order(rows: DataFrame, late: str = "2 hours", forget_hours: int = 24 * 7) -> DataFrame:
    """folder, event_id, us (event time in microseconds), value, gap_us and late, of a stream
    of accesses (event_id, ts, user_id, value). An access at an earlier one's time counts
    as after it by event_id. Rows without a time or an id are in no order and are left out;
    a null folder has the key -1."""
    at = F.col("ts").cast("timestamp")
    rows = rows.filter("ts is not null and event_id is not null").withColumn("at", at).withWatermark("at", late)
    # the time goes on as a number: Spark drops late rows where it sees the watermark's column
    rows = rows.select(F.coalesce("user_id", F.lit(-1).cast("long")).alias("folder"), "event_id", F.unix_micros("at").alias("us"), "value")
    return rows.groupBy("folder").transformWithStateInPandas(InOrder(forget_hours * 3_600_000_000), OUT, "Append", "EventTime")


def gaps(rows: DataFrame, forget_hours: int = 24 * 7) -> DataFrame:
    """What ``in_order`` tells in the end of a whole log without late rows, in one batch."""
    rows = rows.filter("ts is not null and event_id is not null").select(F.coalesce("user_id", F.lit(-1).cast("long")).alias("folder"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("folder").orderBy("us", "event_id"))
    return rows.select("folder", "event_id", "us", "value", F.when(gap <= forget_hours * 3_600_000_000, gap).alias("gap_us"))


def ended(writer: DataStreamWriter, out: str | None = None, quiet: bool = False) -> StreamingQuery:
    """Start a query that handles all that has arrived, then ends. ``quiet``: for sources that
    don't tell when that is, it runs until nothing is left to do and is stopped then."""
    if not quiet:
        return writer.trigger(availableNow=True).start(out)
    query = writer.start(out)
    query.processAllAvailable()
    query.stop()
    return query


def to_tables(told: DataFrame, out: str, checkpoint: str, quiet: bool = False) -> StreamingQuery:
    """Write ordered rows to ``out/ordered`` and late ones to ``out/late``, a folder a batch.

    A batch that is run again after a failure writes the same folder again, so no row
    is there twice. Handles all that has arrived, then ends."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in (("ordered", batch.filter("not late").drop("late")), ("late", batch.filter("late").drop("late", "gap_us"))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    return ended(told.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint), quiet=quiet)
