"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length one and projected on random normal directions; each
projection, shifted and divided into cells, falls near itself for near vectors
(Datar et al. 2004). Several projections make a bucket, and vectors that share a
bucket in two or three tables are candidates, whose cosines are then computed exactly.
Counting the shared tables costs two ids a meeting, where a check costs two vectors:
a pair at the bound meets several times, unlike pairs seldom more than once. How
unlike the pairs of a label are is measured, as in most embeddings they are not
orthogonal, and projections and tables are fitted to that.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Cuts, components

#: Least projections of a bucket and tables, width of a cell, and numbers of tables
#: that candidates must share (fitted; the first if not). Two vectors of cosine 0.93 share as many with probability 0.996,
#: nearer ones more likely.
PROJECTIONS, TABLES, CELL, SHARED = 10, 68, 1.5, (2, 3)
SEED = 20_240_607
#: Chance that a pair at the bound is missed, most projections tried, and vectors (as
#: expected) from whose pairs the cosines of a label are measured.
MISS, MOST, SAMPLE = 0.004, 64, 1024
#: Bytes shuffled for a vector's bucket (to find its mates, and to both sides of their
#: join) and for a meeting; a check moves two vectors besides.
BUCKET_BYTES, MEETING_BYTES = 48, 16


def same_cell(distance: float, cell: float) -> float:
    """The probability that a projection puts two vectors so far apart in one cell."""
    if distance <= 0:
        return 1.0
    r = cell / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def below_shared(p, tables: int, shared: int):
    """The probability that a pair with chance ``p`` in each table shares under ``shared`` of them."""
    p = np.asarray(p, float)
    return sum(math.comb(tables, j) * p**j * (1 - p) ** (tables - j) for j in range(shared))


def tables_for(projections: int, least: float, cell: float = CELL, shared: int = SHARED[0]) -> int:
    """The fewest tables that miss a pair at the bound with a chance of at most MISS."""
    p = same_cell(math.sqrt(max(0.0, 2 - 2 * least)), cell) ** projections
    low, high = shared - 1, shared
    while below_shared(p, high, shared) > MISS:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if below_shared(p, middle, shared) > MISS else (low, middle)
    return high


def fitting(vectors: float, least: float, cell: float = CELL, cosines: tuple[np.ndarray, np.ndarray] | None = None, dimension: int = 64) -> tuple[int, int, int]:
    """(projections, tables, tables to share) that move the fewest bytes where a vector has so many others in its label.

    ``cosines``: (cosine, share) of the pairs that are no links; orthogonal if not
    given. More projections keep unlike pairs apart and ask for more tables; a third
    shared table is worth its cost where unlike pairs are near each other."""
    cosine, share = cosines or (np.zeros(1), np.ones(1))
    one = np.array([same_cell(math.sqrt(max(0.0, 2 - 2 * c)), cell) for c in cosine])
    best = None
    for shared, projections in itertools.product(SHARED, range(PROJECTIONS, MOST + 1)):
        tables = max(TABLES, tables_for(projections, least, cell, shared))
        if best and BUCKET_BYTES * tables > best[0]:
            continue
        met = vectors / 2 * tables * float(share @ one**projections)
        checked = vectors / 2 * float(share @ (1 - below_shared(one**projections, tables, shared)))
        cost = BUCKET_BYTES * tables + MEETING_BYTES * met + (MEETING_BYTES + 16 * dimension) * checked
        if best is None or cost < best[0]:
            best = cost, projections, tables, shared
    return best[1:]


def unlinked_cosines(labels: np.ndarray, vectors: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(cosine, share) of the pairs of one label and length under ``least``, in bins
    told by their upper ends; None without such pairs."""
    edges = np.linspace(-1, least, 401)
    counts = np.zeros(400)
    sizes = np.array([len(v) for v in vectors], np.int64)
    for label, size in sorted(set(zip(labels.tolist(), sizes.tolist(), strict=True))):
        x = np.array([vectors[i] for i in np.flatnonzero((labels == label) & (sizes == size))])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = (x @ x.T)[np.triu_indices(len(x), 1)]
        counts += np.histogram(np.maximum(c[c < least], -1), edges)[0]
    at = np.flatnonzero(counts)
    return (edges[at + 1], counts[at] / counts.sum()) if len(at) else None


def directions(dimension: int, projections: int, tables: int, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, shifts, odd multipliers) of a dimension, the same everywhere."""
    rng = np.random.Generator(np.random.PCG64([SEED, dimension]))
    normal = rng.standard_normal((dimension, projections * tables))
    return normal, rng.uniform(0, cell, projections * tables), rng.integers(1, 1 << 62, projections, dtype=np.int64) * 2 + 1


def buckets(unit: np.ndarray, label: np.ndarray, projections: int = PROJECTIONS, tables: int = TABLES, cell: float = CELL) -> np.ndarray:
    """Bucket keys, a row for each vector and a column for each table. Vectors of
    different labels or tables never share a key but by a 64-bit collision."""
    normal, shift, odd = directions(unit.shape[1], projections, tables, cell)
    cells = np.floor((unit @ normal + shift) / cell).astype(np.int64).reshape(len(unit), tables, projections)
    with np.errstate(over="ignore"):
        key = (cells * odd).sum(axis=2) + (label[:, None] * tables + np.arange(tables)[None, :] + unit.shape[1] * 1_000_003) * np.int64(0x5851F42D4C957F2D)
        key ^= (key >> np.int64(31)) & np.int64((1 << 33) - 1)
        return key * np.int64(0x2545F4914F6CDD1D)


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _hashed(vectors: DataFrame, projections: int, tables: int, cell: float) -> DataFrame:
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("bucket", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                for some in np.array_split(at, len(at) * projections * tables // 1_000_000 + 1):
                    x = matrix(batch.column(3).take(pa.array(some)))
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    key = buckets(x, label[some].astype(np.int64), projections, tables, cell)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[some], tables)), pa.array(key.ravel())], names=["node", "bucket"])

    return vectors.select("node", "label", F.size("v"), "v").mapInArrow(run, schema)


def _exact(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of one label and of at least that cosine. Buckets keep labels
    apart by a hash only, so labels are compared too."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"), F.col("v").alias(f"v{side}")), side)
    pairs = pairs.filter("la = lb")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            good = np.zeros(len(batch), bool)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x, y = (matrix(batch.column(i).take(pa.array(at))) for i in (2, 3))
                x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
                dot = np.einsum("ij,ij->i", x, y)
                good[at] = dot / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= least
            yield batch.select([0, 1]).filter(pa.array(good))

    return pairs.select("a", "b", "va", "vb").mapInArrow(run, schema)


def near_vectors(df: DataFrame, least: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id", projections: int | None = None, tables: int | None = None, cell: float = CELL, shared: int | None = None) -> DataFrame:
    """One row per row of ``df``: the key, n_links, component_id, kept.

    Vectors of one label and length are linked where their cosine, in double
    precision, is at least ``least``. n_links: other rows linked directly;
    component_id: the smallest key reachable, itself included; kept: the key is that
    one. Vectors that are null, empty, zero or hold a null, infinite or NaN
    component, and rows without label or key, link with nothing: no links, their own
    component; without a key component_id is null and kept false. Equal vectors are
    one class, counted but not paired. Vectors that share a key are taken as one
    node. Other columns are ignored; key and label must be integers.

    Candidates come from hashing: a pair at the bound is missed with a probability
    that the parameters set, unless a ball holds it; no pair below it is linked.
    Those not given are fitted (``fitting``) to the number of vectors of a label and
    to the cosines among about SAMPLE vectors, drawn by hash from all.
    """
    cuts = Cuts(df.sparkSession)
    v = F.col("v")
    fit = F.col("node").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
    fit &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("node"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v", "label")})
    classes = rows.filter("fit").groupBy("h1", "h2").agg(F.min(F.struct("node", "label", "v")).alias("x"), F.count("*").alias("rows"))
    classes = cuts.cut(classes.select("h1", "h2", "x.*", "rows"))

    if projections is None or tables is None:
        rows_of = F.col("count").cast("double")
        one = classes.groupBy("label").count().agg(F.sum(rows_of).alias("all"), F.sum(rows_of * rows_of).alias("pairs")).first()
        drawn = classes.filter(F.pmod(F.xxhash64(F.lit(SEED), "h1", "h2"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / (one["all"] or 1)))
        drawn = drawn.select("label", "v").toArrow()
        seen = [np.array(v) for v in drawn["v"].to_pylist()]
        seen = unlinked_cosines(drawn["label"].to_numpy(), seen, least), max(map(len, seen), default=64)
        fitted = fitting((one["pairs"] or 0) / (one["all"] or 1), least, cell, *seen)
        projections, tables, shared = projections or fitted[0], tables or fitted[1], shared or fitted[2]
    shared = min(shared or SHARED[0], tables)
    by_bucket = Window.partitionBy("bucket")
    hashed = _hashed(classes, projections, tables, cell).withColumns({"centre": F.min("node").over(by_bucket), "mates": F.count("*").over(by_bucket)})
    hashed = cuts.cut(hashed.filter("mates > 1").drop("mates"))  # a vector alone in its bucket meets none there
    often = lambda met: met.groupBy("a", "b").count().filter(F.col("count") >= shared).drop("count")
    near = _exact(often(hashed.filter("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))), classes, np.cos(np.arccos(least) / 2) + 1e-9)
    balls = cuts.cut(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("ball")))
    hashed = hashed.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", "node"))
    left, right = (hashed.select(F.col("node").alias(c), F.col("ball").alias(f"{c}_ball"), "bucket") for c in ("a", "b"))
    pairs = cuts.cut(often(left.join(right, "bucket").filter("a < b and a_ball != b_ball").select("a", "b")))
    links = cuts.cut(_exact(pairs, classes, least).distinct())

    both = links.union(links.select("b", "a")).toDF("node", "other")
    sizes = cuts.cut(classes.groupBy("node").agg(F.sum("rows").alias("rows")).join(balls, "node", "left").withColumn("ball", F.coalesce("ball", "node")))
    degree = both.join(sizes.select(F.col("node").alias("other"), "rows"), "other").groupBy("node").agg(F.sum("rows").alias("degree"))
    inside = cuts.cut(sizes.groupBy("ball").agg(F.sum("rows").alias("inside")))
    found = components(links.union(balls.select("node", "ball")), "a", "b")
    known = classes.select("h1", "h2", "node").join(sizes.join(inside, "ball").select("node", "inside"), "node").join(degree, "node", "left").join(found, "node", "left")
    known = cuts.cut(known.select("h1", "h2", (F.col("inside") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = rows.select("node", "h1", "h2", "fit").join(known.withColumn("fit", F.lit(True)), ["h1", "h2", "fit"], "left")
    component = F.when(F.col("node").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "node"))
    return out.select(
        F.col("node").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("node") == component, F.lit(False)).alias("kept"),
    )
