"""An index over a vector store: cells, codes of what is left, and an exact last look.

Every unit vector goes to the nearest of some cells; what is left of it, cut into parts of
four components, is written as the number of the nearest of 256 codes for each part. A
query looks into the cells nearest to it. There it is compared with a vector by adding up
a table's entries for the vector's codes; the best by those sums, and those within a
margin below the k-th, get their exact cosine. How many cells to look into and how wide
the margin is are measured when the index is fitted, on a sample, against the sample's
true neighbours.

Cells and codes are learned from ``sample`` vectors, the first by hash. All vectors are
indexed. A cell of many vectors is dealt to several tasks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import runs
from tidemark.sources.scratch import Scratch

#: Vectors of the sample and of a task, queries at a time, components of a part, codes of a part.
SAMPLE, TOGETHER, STEP, WIDTH, CODES = 16_384, 8_192, 64, 4, 256
#: Cells at most, so that a table of them stays small (4 MB at 256 components).
MOST_CELLS = 4_096


@dataclass
class Index:
    """What a search needs besides the vectors; a few MB, whatever they are."""

    cells: np.ndarray  # (cells, dimensions)
    codes: np.ndarray  # (parts, codes, width)
    probes: int
    margin: float
    pieces: list[int]  # tasks that share a cell's vectors


def usable(v: Column) -> Column:
    """Vectors with a cosine: some components, all of them finite, one of them not zero."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _rows(df: DataFrame, key: str, vector: str, dimensions: int | None = None) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias(key), v.alias("v")).filter(F.col(key).isNotNull() & usable(F.col("v")))
    return rows if dimensions is None else rows.filter(F.size("v") == dimensions)


def _units(column: pa.ListArray) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[a : a + 4096] @ centres.T - half).argmax(axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of a bounded sample, beginning with rows spread over it."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _coded(x: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, codes of each part) of unit vectors."""
    at = _nearest(x, cells)
    left = np.pad(x - cells[at], ((0, 0), (0, codes.shape[0] * codes.shape[2] - x.shape[1]))).reshape(len(x), codes.shape[0], -1)
    return at, np.stack([_nearest(left[:, p], codes[p]) for p in range(codes.shape[0])], axis=1).astype(np.uint8)


def _sums(q: np.ndarray, at: np.ndarray, coded: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """About the cosine of each query with each coded vector, by table sums."""
    parts = np.pad(q, ((0, 0), (0, codes.shape[0] * codes.shape[2] - q.shape[1]))).reshape(len(q), codes.shape[0], -1)
    table = np.einsum("qpw,pcw->pcq", parts, codes)
    out = (cells @ q.T)[at]
    for p in range(codes.shape[0]):
        out += table[p][coded[:, p]]
    return out.T


def fit(vectors: DataFrame, k: int = 5, wanted: float = 0.97, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, cells: int | None = None) -> Index:
    """Learn an index. Of the sample's true neighbours the share ``wanted`` lies in the
    cells looked into, and of those the same share within the margin.

    The commonest length of the sample's vectors is the index's; others aren't indexed."""
    rows = _rows(vectors, key, vector)
    taken = rows.orderBy(F.xxhash64(key), key).limit(sample).toArrow().column("v").combine_chunks()
    lengths = pa.compute.list_value_length(taken).to_numpy(zero_copy_only=False)
    if not len(lengths):
        raise ValueError("no vector to learn from")
    size = np.bincount(lengths).argmax()
    x = _units(taken.take(pa.array(np.flatnonzero(lengths == size))))
    many = min(MOST_CELLS, len(x), cells or max(1, round(rows.count() ** 0.5)))
    centres = _centres(x, many)
    at = _nearest(x, centres)
    left = np.pad(x - centres[at], ((0, 0), (0, -size % WIDTH))).reshape(len(x), -1, WIDTH)
    codes = np.stack([_centres(left[:, p], min(CODES, len(x))) for p in range(left.shape[1])])
    at, coded = _coded(x, centres, codes)
    asked = np.arange(0, len(x), max(1, len(x) // 256))
    true = x[asked] @ x.T
    true[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-true, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(-(x[asked] @ centres.T), axis=1).argsort(axis=1)
    deep = np.take_along_axis(order, at[best], axis=1)
    probes = min(many, int(np.quantile(deep, wanted, method="higher")) + 1) if best.size else many
    error = _sums(x[asked], at, coded, centres, codes) - np.where(np.isfinite(true), true, 0)
    own = np.take_along_axis(error, best, axis=1)
    # a neighbour may be told too low while the k-th is told too high
    margin = float(np.quantile(-own, wanted) + np.quantile(error, wanted)) if best.size else 1.0
    model = Index(centres, codes, probes, max(margin, 0.0), [1] * many)
    counts = encoded(model, vectors, key, vector).groupBy("cell").count().collect()  # cells, at most MOST_CELLS
    for r in counts:
        model.pieces[r.cell] = -(-r["count"] // TOGETHER)
    return model


def encoded(model: Index, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cell, piece, codes, v) of every vector with a cosine and the index's length."""
    cells, codes = model.cells, model.codes

    def run(batches):
        for batch in batches:
            at, coded = _coded(_units(batch.column(1)), cells, codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in coded], pa.binary()), batch.column(1)], names=["vec_id", "cell", "codes", "v"])

    out = _rows(vectors, key, vector, cells.shape[1]).select(F.col(key).alias("vec_id"), "v").mapInArrow(run, "vec_id long, cell int, codes binary, v array<double>")
    pieces = F.element_at(F.array(*[F.lit(p) for p in model.pieces]), F.col("cell") + 1)
    return out.select("vec_id", "cell", F.pmod(F.xxhash64("vec_id"), pieces).cast("int").alias("piece"), "codes", "v")


def probed(model: Index, queries: DataFrame, key: str = "query_id", vector: str = "q") -> DataFrame:
    """(cell, piece, query_id, v): where each query looks."""
    cells, probes, pieces = model.cells, model.probes, np.array(model.pieces)

    def run(batches):
        for batch in batches:
            at = np.argsort(-(_units(batch.column(1)) @ cells.T), axis=1, kind="stable")[:, :probes] if len(batch) else np.zeros((0, probes), int)
            row, cell = np.repeat(np.arange(len(batch)), at.shape[1]), at.ravel()
            row, cell, n = np.repeat(row, pieces[cell]), np.repeat(cell, pieces[cell]), pieces[cell]
            piece = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            for a in range(0, len(row), 4096):
                some = pa.array(row[a : a + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 4096], pa.int32()), pa.array(piece[a : a + 4096], pa.int32()), batch.column(0).take(some), batch.column(1).take(some)], names=["cell", "piece", "query_id", "v"])

    return _rows(queries, key, vector, cells.shape[1]).select(F.col(key).alias("query_id"), "v").mapInArrow(run, "cell int, piece int, query_id long, v array<double>")


def search(model: Index, store: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """About the k nearest of a store for each of ``queries`` (query_id, q), itself left out:
    query_id, vec_id, cosine (exact), rank; ties by id. Queries of another length, or
    without a cosine, find nothing."""
    cells, codes, margin = model.cells, model.codes, model.margin
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [schema.empty_table()]
        if len(left) and len(right):
            left, right = left.combine_chunks(), right.combine_chunks()
            ids, asked = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
            x, q = _units(left["v"].combine_chunks()), _units(right["v"].combine_chunks())
            at, coded = left["cell"].to_numpy(), np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
            for a in range(0, len(q), STEP):
                rough = _sums(q[a : a + STEP], at, coded, cells, codes)
                rough[asked[a : a + STEP, None] == ids] = -np.inf
                n = max(0, len(ids) - k)
                row, col = np.nonzero((rough >= np.partition(rough, n, axis=1)[:, n, None] - margin) & (rough > -np.inf))
                near = np.clip(np.einsum("ij,ij->i", q[a + row], x[col]), -1, 1)
                order = np.lexsort((ids[col], -near, row))
                row, col, near = row[order], col[order], near[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                found.append(pa.Table.from_arrays([pa.array(asked[a + row[first]]), pa.array(ids[col[first]]), pa.array(near[first])], schema=schema))
        return pa.concat_tables(found)

    near = store.groupBy("cell", "piece").cogroup(probed(model, queries).groupBy("cell", "piece")).applyInArrow(run, "query_id long, vec_id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def compared(model: Index, store: DataFrame, queries: DataFrame) -> int:
    """Pairs of a query and a vector that a search adds up table entries for."""
    sizes = store.groupBy("cell", "piece").agg(F.count("*").alias("n"))
    asked = probed(model, queries).groupBy("cell", "piece").agg(F.count("*").alias("m"))
    return sizes.join(asked, ["cell", "piece"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]


def save(model: Index, vectors: DataFrame, root: str, run_id: str) -> list[str]:
    """Write an index and its encoded vectors, sorted by cell, as a run of a store."""
    spark = vectors.sparkSession
    rows = [("cells", i, 0, c.tolist(), None) for i, c in enumerate(model.cells)] + [("codes", p, i, c.tolist(), None) for p, part in enumerate(model.codes) for i, c in enumerate(part)]
    rows.append(("told", 0, 0, None, json.dumps({"probes": model.probes, "margin": model.margin, "pieces": model.pieces})))
    table = spark.createDataFrame(rows, "what string, i int, j int, v array<double>, told string").coalesce(1)
    store = encoded(model, vectors).repartitionByRange("cell", "piece").sortWithinPartitions("cell", "piece")
    return [runs.save(store, root, "vector_store", run_id), runs.save(table, root, "vector_index", run_id)]


def load(spark: SparkSession, root: str, run_id: str) -> tuple[Index, DataFrame]:
    """(index, store) of a run."""
    rows = spark.read.parquet(f"{root}/vector_index/run_id={run_id}").orderBy("what", "i", "j").collect()
    told = json.loads(next(r.told for r in rows if r.what == "told"))
    cells = np.array([r.v for r in rows if r.what == "cells"])
    codes = [r for r in rows if r.what == "codes"]
    parts = codes[-1].i + 1
    return Index(cells, np.array([r.v for r in codes]).reshape(parts, len(codes) // parts, -1), told["probes"], told["margin"], told["pieces"]), spark.read.parquet(f"{root}/vector_store/run_id={run_id}")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Fit, encode and search at once."""
    cut = Scratch(vectors.sparkSession).cut(vectors.select("vec_id", "embedding"))
    model = fit(cut, k)
    return search(model, encoded(model, cut), queries, k)
