"""Path semantics: tokens, rollups, hashed vectors, nearest vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import bucket, first_segment, host

#: Vectors and queries that one call compares, and queries that it takes at a time.
VECTORS, ASKED, STEP = 8192, 2048, 256
#: More than the rounding error of a product of unit vectors.
SLACK = 1e-9


def tokens(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", host(F.col("url")).alias("host"), first_segment(F.col("url")).alias("segment"))


def prefix_rollup(rows: DataFrame) -> DataFrame:
    """Counts by host and segment, by host, and in all; level tells which."""
    return rows.rollup("host", "segment").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n")).select("host", "segment", "level", "n")


def hashed_counts(pages: DataFrame, buckets: int = 32) -> DataFrame:
    """Sparse vector of each url: how many of its tokens fall in each bucket."""
    words = F.filter(F.split("url", r"[/:?#&=]+"), lambda w: w != "")
    return pages.select("page_id", F.explode(words).alias("token")).groupBy("page_id", bucket(F.col("token"), 4, buckets).alias("bucket")).agg(F.count("*").alias("n"))


def _path_words(pages: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.coalesce("url", F.lit("")), r"[/:?#&=]+"), lambda w: w != "")
    return pages.select("page_id", words.alias("words"))


def path_encoder(pages: DataFrame, buckets: int = 256, dimensions: int = 32) -> PipelineModel:
    """A dense encoder of urls learned from all of them: hashed word counts, weighed by
    inverse document frequency, on their principal directions, of length one.

    What the driver holds depends on ``buckets`` alone (a covariance of 256 x 256)."""
    hashed = HashingTF(inputCol="words", outputCol="counts", numFeatures=buckets)
    weighed = IDF(inputCol="counts", outputCol="weighed")
    reduced = PCA(k=dimensions, inputCol="weighed", outputCol="reduced")
    return Pipeline(stages=[hashed, weighed, reduced, Normalizer(inputCol="reduced", outputCol="unit")]).fit(_path_words(pages))


def encoded_paths(model: PipelineModel, pages: DataFrame) -> DataFrame:
    """vec_id (the page's id) and embedding of each page, one row a row: what a vector
    store holds and ``nearest_in_blocks`` searches. A url without words is all zeros,
    which is near nothing."""
    return model.transform(_path_words(pages)).select(F.col("page_id").alias("vec_id"), vector_to_array("unit", "float32").alias("embedding"))


def _scaled(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix with each row times a power of two, so that no square overflows, and
    the squares' sums in the order of the components."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, _dots(x, x)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products row by row; equal rows give the same bits wherever they stand."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def _cell(k: int, decimals: int | None):
    """The k nearest of one block of vectors for each query of one block."""
    slack = SLACK if decimals is None else SLACK + 10.0**-decimals
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = (t.combine_chunks() for t in (left, right))
        lengths = [pa.compute.list_value_length(t["v"]).to_numpy() for t in (left, right)]
        found = [schema.empty_table()]
        for d in np.intersect1d(*lengths):
            some, few = (t.take(pa.array(np.flatnonzero(n == d))).combine_chunks() for t, n in zip((left, right), lengths, strict=True))
            ids, asked = some["vec_id"].to_numpy(), few["query_id"].to_numpy()
            (v, vv), (q, qq) = (_scaled(t["v"].chunk(0)) for t in (some, few))
            unit = (v / np.sqrt(vv)[:, None]).T
            for a in range(0, len(q), STEP):
                rough = (q[a : a + STEP] / np.sqrt(qq[a : a + STEP])[:, None]) @ unit
                rough[asked[a : a + STEP, None] == ids] = -np.inf
                at = max(0, len(ids) - k)
                least = np.partition(rough, at, axis=1)[:, at, None] - slack
                row, col = np.nonzero((rough >= least) & (rough > -np.inf))
                row += a
                near = np.concatenate([np.zeros(0), *(_dots(q[row[i : i + 65_536]], v[col[i : i + 65_536]]) for i in range(0, len(row), 65_536))])
                near = np.clip(near / np.sqrt(qq[row] * vv[col]), -1, 1)
                near = near if decimals is None else np.round(near, decimals)
                order = np.lexsort((ids[col], -near, row))
                row, col, near = row[order], col[order], near[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                found.append(pa.Table.from_arrays([pa.array(asked[row[first]]), pa.array(ids[col[first]]), pa.array(near[first])], schema=schema))
        return pa.concat_tables(found)

    return run


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int = 5, vector_block: int = VECTORS, query_block: int = ASKED, decimals: int | None = None) -> DataFrame:
    """The k of ``vectors`` (vec_id, embedding) of highest cosine for each of
    ``queries`` (query_id, q), itself excluded: query_id, vec_id, cosine, rank.

    Ranks go by the double cosine, rounded first if ``decimals`` are given, then by id. Any number of queries:
    both sides are dealt into blocks by hash, each pair of blocks is compared in one
    call that returns k rows a query, and those are ranked. Ids must be distinct
    integers. Vectors of another length are not compared; those that are null,
    empty, zero or hold a null, infinite or NaN component have no cosine and are
    left out on both sides.
    """
    v = F.col("v")
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    sides = []
    for df, key, vector, size in ((vectors, "vec_id", "embedding", vector_block), (queries, "query_id", "q", query_block)):
        rows = df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).filter(F.col(key).isNotNull() & fit)
        sides.append((rows, key, max(1, -(-rows.count() // size))))
    (left, vec_id, many), (right, query_id, few) = sides
    left = left.select(F.pmod(F.xxhash64(vec_id), F.lit(many)).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(few - 1)).cast("array<bigint>")).alias("qb"), vec_id, "v")
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<bigint>")).alias("vb"), F.pmod(F.xxhash64(query_id), F.lit(few)).alias("qb"), query_id, "v")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("cosine", T.DoubleType())])
    near = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(_cell(k, decimals), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)
