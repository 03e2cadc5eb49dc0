"""Helpers shared by the operators: cut points, text mapping, folds, components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that Spark sends a Python worker, where the session has no bound of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``, else from the context. Only a local
    session without either gets a temporary folder; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends Arrow batches of about ``BATCH_BYTES``.

    By default a batch has up to 64 MB, and each task holds it several times over: in
    Spark, outside of the heap and while it grows twice, and in the Python worker. A longer row is
    a batch by itself. A bound that the session has been given stays."""
    conf = df.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def _remove(jvm, path: str) -> None:
    """Delete a folder of this process's tables; what can't be reached stays."""
    with contextlib.suppress(Exception):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)


class Cuts:
    """Tables written to the shared folder, so that lineage ends there.

    They last as long as the driver's process: results are read from them later."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self.made, self.paths = 0, {}
        atexit.register(_remove, spark._jvm, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *cuts: DataFrame) -> None:
        """Delete cuts that no later read needs; what is no cut of these stays."""
        for df in cuts:
            _, path = self.paths.pop(id(df), (None, None))
            if path is not None:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold 1 of 3 by CRC-32 of the id's decimal text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, one row at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def map_texts(df: DataFrame, text: str, added: T.StructType, setup: Callable[[], Callable[[list], list]], keep_text: bool = True, limit: int = SLICE_BYTES) -> DataFrame:
    """Append columns computed from a text column, in Arrow batches.

    ``setup`` runs once for each task and returns ``fn(texts) -> [values of each
    added column]`` for about ``limit`` bytes of texts at a time. A column of ``df``
    named like an added one, in whatever case, is replaced; all others pass unchanged.
    Rows neither move nor merge.
    """
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names and (keep_text or f.name != text)]
    wanted = [f.name for f in kept] + ([] if any(f.name == text for f in kept) else [text])
    kinds = [to_arrow_type(f.dataType) for f in added]
    out_names = [f.name for f in kept] + [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = setup()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(column, limit):
                values = fn(column.slice(a, b - a).to_pylist())
                arrays = [batch.column(batch.schema.get_field_index(f.name)).slice(a, b - a) for f in kept]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v, type=k) for v, k in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    return small_batches(df).select(*[F.col(f"`{n}`") for n in wanted]).mapInArrow(run, T.StructType(kept + list(added)))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: (node, component), the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al. 2014). Each
    round's tables are written to the shared folder, so that every join reads two
    plain scans: adaptive execution can then split a node with very many edges.
    Nodes without an edge are absent. Null ends are ignored.
    """
    cuts = Cuts(edges.sparkSession)
    pair = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = cuts.cut(edges.select(*pair(F.col(a), F.col(b))).filter("u > v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = mark
        both = now.union(now.select("v", "u"))
        least = cuts.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cuts.cut(both.join(least, "u").filter("v > u").select(*pair(F.col("v"), F.col("m"))).filter("u > v").distinct())
        less = cuts.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(less, "u").select("v", "m").union(less.select("u", "m"))
        last, now = now, cuts.cut(moved.select(*pair(F.col("v"), F.col("m"))).filter("u > v").distinct())
        cuts.drop(last, least, large, less)
