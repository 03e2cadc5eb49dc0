"""Clustering of vectors round centroids in whole numbers, with block norms to spare distances.

Every vector has its squared norm and the norms of its segments worked out once; those
segment norms are its compressed form. With those of a centroid they bound the squared
distance from below, by Cauchy and Schwarz in each segment:

    |x|^2 + |c|^2 - 2 sum over segments |x_s| |c_s|  <=  |x - c|^2

Norms are taken from the centroids' own mean, since moving both sides alike changes no
distance and brings the segments' directions to bear. The centroid of least bound gets
its exact distance; then only those whose bound is not over it do. All distances and
sums are exact whole numbers.

A round reads the vectors once where they lie. A task sends, for each centroid, a count
and the sums of the components in two halves of 32 bits; Spark adds those up, and the
driver holds ``k`` centroids, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Cuts

#: Components of a segment.
SEGMENT = 8
#: Vectors that a worker compares at a time.
ROWS = 4096
#: Greatest magnitude of a component after scaling; what is beyond counts as that much.
MOST = 1 << 46
#: Up to this magnitude 64-bit arithmetic can't overflow in up to 512 components.
SAFE = 1 << 26


def _whole(scale: int, dimensions: int):
    """Keep vectors of ``dimensions`` finite components, as whole numbers floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            fit = np.flatnonzero(pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dimensions)
            column = column.take(pa.array(fit))
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), dimensions)  # a null becomes NaN
            good = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(x[good] * scale), -MOST, MOST).astype(np.int64)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit[good])), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["vec_id", "v"])

    return run


def _segment_norms(x: np.ndarray) -> np.ndarray:
    starts = np.arange(0, x.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(x * x, starts, axis=1))


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances row by row, as Python's whole numbers where 64 bits may not do."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) > SAFE:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=1)


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, its exact squared distance, number of exact distances) of rows
    of whole numbers; the smaller number wins a tie."""
    shift = centroids.astype(np.float64).mean(axis=0)
    fx, fc = x - shift, centroids - shift
    nx, nc = _segment_norms(fx), _segment_norms(fc)
    own = (nx * nx).sum(axis=1)[:, None] + (nc * nc).sum(axis=1)[None, :]
    # rounding is a few units in the last place of the sums, of the components before the shift too
    slack = own * 1e-12 + (np.abs(x).max(axis=1, initial=0)[:, None] + np.abs(centroids).max(initial=0)).astype(np.float64) ** 2 * 1e-13 * x.shape[1]
    bound = own - 2 * nx @ nc.T - slack
    rows = np.arange(len(x))
    first = bound.argmin(axis=1)
    best, at = _exact(x, centroids[first]), first.copy()
    bound[rows, first] = np.inf
    row, col = np.nonzero(bound <= best.astype(np.float64)[:, None] * (1 + 1e-15))
    for a in range(0, len(row), 4 * ROWS):
        r, c = row[a : a + 4 * ROWS], col[a : a + 4 * ROWS]
        d = _exact(x[r], centroids[c])
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        lead = np.concatenate((np.ones(min(1, len(r)), bool), r[1:] != r[:-1]))
        r, c, d = r[lead], c[lead], d[lead]
        better = (d < best[r]) | ((d == best[r]) & (c < at[r]))
        if d.dtype == object and best.dtype != object:
            best = best.astype(object)
        best[r[better]], at[r[better]] = d[better], c[better]
    return at, best, len(x) + len(row)


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            part = batch.slice(a, ROWS)
            yield part, part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dimensions)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor of the mean of the vectors nearest to each."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(k, np.int64)
        low, high = np.zeros((k, dimensions), np.int64), np.zeros((k, dimensions), np.int64)
        for _, x in _blocks(batches, dimensions):
            at, _, _ = assign(x, centroids)
            count += np.bincount(at, minlength=k)
            np.add.at(low, at, x & 0xFFFFFFFF)
            np.add.at(high, at, x >> 32)
        cluster, component = (a.ravel() for a in np.indices((k, dimensions)))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (cluster, component, count[cluster], low.ravel(), high.ravel())], names=["cluster", "component", "n", "low", "high"])

    parts = vectors.select("v").mapInArrow(run, "cluster long, component long, n long, low long, high long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = centroids.copy()
    for r in parts.groupBy("cluster", "component").agg(total("n"), total("low"), total("high")).collect():  # k times dimensions rows
        if r.n:
            out[r.cluster, r.component] = ((int(r.high) << 32) + int(r.low)) // int(r.n)
    return out


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dimensions):
            at, distance, _ = assign(x, centroids)
            fits = [int(d) if d < 1 << 63 else None for d in distance] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dimensions: int = 64, key: str = "vec_id", vector: str = "embedding", salt: Column | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of each vector kept, and the
    final centroids as rows of whole numbers.

    Vectors that are null, have another length or hold a null or non-finite component
    are left out. Components become floor(scale * x). The first centroids are the ``k``
    vectors of smallest SHA-256 of ``1:`` and the id (``salt`` replaces that text), of
    equal ids those with smaller components first, null ids last; with fewer vectors
    there are fewer centroids. Each of ``rounds`` rounds assigns each vector to the
    nearest centroid (ties: the smaller number), then moves every centroid that has any
    to the floor of their mean. Repeated rows count and are returned as often as they
    occur; an empty table, or one that keeps none, gives no rows. Columns besides the
    two are not read. A magnitude over 2^46 after scaling counts as 2^46; a distance
    or sum that a long can't hold is null.
    """
    cuts = Cuts(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    vectors = cuts.cut(rows.mapInArrow(_whole(scale, dimensions), "vec_id long, v array<long>"))
    salt = F.concat(F.lit("1:"), F.col("vec_id").cast("string")) if salt is None else salt
    first = vectors.select(F.sha2(salt, 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dimensions)
    if not len(centroids):
        none = F.lit(None).cast("long")
        return vectors.select("vec_id", F.lit(0).alias("cluster"), none.alias("distance"), none.alias("cluster_inertia"), none.alias("inertia")).limit(0), centroids
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)
    near = cuts.cut(_assigned(vectors, centroids))
    cuts.drop(vectors)
    known = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(F.col(c).cast("decimal(38,0)")))
    sums = near.groupBy("cluster").agg(known("distance").alias("s")).collect()  # k rows
    whole = sum(r.s for r in sums) if all(r.s is not None for r in sums) else None
    fitting = lambda s: None if s is None or s >= 1 << 63 else int(s)
    each = F.create_map(*[F.lit(x) for r in sums for x in (r["cluster"], fitting(r.s))])
    each = F.try_element_at(each, F.col("cluster")).cast("long")
    return near.select("vec_id", "cluster", "distance", each.alias("cluster_inertia"), F.lit(fitting(whole)).cast("long").alias("inertia")), centroids
