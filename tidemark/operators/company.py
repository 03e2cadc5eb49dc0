"""Vectors of paths by the company they keep: co-occurrence, PPMI and a randomised SVD.

Accesses of one session that stand few places apart count as a pair. Pairs that are
commoner than chance weigh the logarithm of how much; others weigh nothing. The matrix
of these weights stays a table of its cells. Its leading directions come from products
of the table with narrow blocks of numbers, one row a path. What the driver sees are
squares as wide as a block (32 or so), never a row for each path.

For the products paths have numbers, dealt to groups by hash, and cells are packed by
their row's group and their column's span of groups. A task holds a span's rows of the
block and adds up one group of rows after another, so what is shuffled are the packed
cells, the block once, and a sum a path and span; never a sum a cell. The columns of a
large block are multiplied a quarter at a time, each by a job whose shuffles then go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.history import micros
from tidemark.sources.scratch import Scratch

#: Paths in a group, about; groups and spans at least, so that tasks are several.
GROUP, LEAST = 60_000, 8
#: Bytes of a block that a task holds, parts in which a block of more is multiplied.
SPAN_BYTES, PARTS = 96 << 20, 4
#: Cells that are packed at once, rows in a piece of a block, cells that are multiplied at once.
PACK, PIECE, STEP = 1 << 21, 4096, 1024
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def visits(trace: DataFrame, session_minutes: int = 60) -> DataFrame:
    """(session, place, path) of accesses: sessions are pieces of time of that length, a path is
    the folder and the kind of access. Rows without folder or time are no visits."""
    piece = F.floor(micros() / (session_minutes * 60_000_000))
    place = F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id"))
    rows = trace.filter("folder is not null and ts is not null").withColumn("session", piece)
    return rows.select("session", place.alias("place"), F.concat(F.lit("log://host/"), F.col("folder").cast("string"), F.lit("/"), F.coalesce("kind", F.lit(""))).alias("path"))


def pairs(seen: DataFrame, reach: int = 5) -> DataFrame:
    """(a, b, n) both ways round: how often two different paths stand at most ``reach`` visits
    apart in a session. Each visit meets the next few only, however long its session."""
    order = Window.partitionBy("session").orderBy("place")
    ahead = seen.select(F.col("path").alias("a"), F.array(*[F.lead("path", k).over(order) for k in range(1, reach + 1)]).alias("ahead"))
    one = ahead.select("a", F.explode("ahead").alias("b")).filter("b is not null and a != b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def weighed(counts: DataFrame) -> DataFrame:
    """(a, b, w): positive pointwise mutual information of the pairs, w > 0."""
    margins = counts.groupBy("a").agg(F.sum("n").alias("m"))
    total = counts.agg(F.sum("n").alias("all"))
    met = counts.join(margins.withColumnRenamed("m", "ma"), "a").join(margins.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
    w = F.ln(F.col("n").cast("double") * F.col("all") / (F.col("ma").cast("double") * F.col("mb")))
    return met.crossJoin(F.broadcast(total)).select("a", "b", w.alias("w")).filter("w > 0")  # one row


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """What is shuffled inside goes as soon as its table is written, not when the driver next collects garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


@dataclass(frozen=True)
class Numbered:
    """``names``: (path, number, and more), number = group * size + place in the group."""

    names: DataFrame
    groups: int
    size: int

    def parts(self, wide: int) -> list[np.ndarray]:
        """The columns of a block that are multiplied together."""
        return np.array_split(np.arange(wide), min(wide, PARTS) if self.groups * self.size * wide * 8 > SPAN_BYTES else 1)

    def span(self, wide: int) -> int:
        """Groups whose rows of a block's part a task holds."""
        return max(1, min(SPAN_BYTES // (self.size * len(self.parts(wide)[0]) * 8), -(-self.groups // LEAST)))


def numbered(scratch: Scratch, paths: DataFrame) -> Numbered:
    """Numbers for different paths; other columns stay."""
    paths = scratch.cut(paths)
    groups = max(LEAST, -(-paths.count() // GROUP))
    dealt = paths.withColumn("g", F.pmod(F.xxhash64("path"), F.lit(groups)))
    dealt = dealt.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("path")).cast("long") - 1)
    placed = scratch.cut(dealt)
    scratch.drop(paths)
    size = (placed.agg(F.max("i")).first()[0] or 0) + 1
    return Numbered(placed.withColumn("number", F.col("g") * size + F.col("i")).drop("g", "i"), groups, size)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _packed(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> bytes:
    """Cells of rows ``i`` (rising) and columns ``j``, byte by byte of their numbers, compressed."""
    i = np.diff(i, prepend=0).astype(np.uint32)
    parts = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (i, j.astype(np.uint32))]
    return len(i).to_bytes(8, "little") + pa.compress(b"".join([*parts, w.astype(np.float64).tobytes()]), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], 16 * n, codec="zstd", asbytes=True), np.uint8)
    i, j = (np.ascontiguousarray(raw[k : k + 4 * n].reshape(4, n).T).view(np.uint32).ravel() for k in (0, 4 * n))
    return np.cumsum(i, dtype=np.int64), j.astype(np.int64), raw[8 * n :].view(np.float64)


_TABLE = "c long, g long, at binary, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c, g, at, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(g, pa.int64()), pa.array(at, pa.binary()), pa.array(data, pa.binary())], names=["c", "g", "at", "data"])


def _pieces(g: int, span: int, at: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a block: group and the group's span, the rows' places in the group, their numbers."""
    for k in range(0, len(at), PIECE):
        yield _rows([(g // span, g, at[k : k + PIECE].astype(np.int32).tobytes(), np.ascontiguousarray(y[k : k + PIECE]).tobytes())])


def _read(at: bytes, data: bytes, by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(at, np.int32)
    y = np.frombuffer(data, np.float64).reshape(len(at), -1)
    for m in by:
        y = y @ m
    return at, y


def packed(cells: DataFrame, numbers: Numbered, wide: int) -> DataFrame:
    """Cells (a, b, w) of numbers as rows of thousands: the columns' span, the rows' group, the cells."""
    size, groups, span = numbers.size, numbers.groups, numbers.span(wide)

    def pack(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, c = a // size, b // (size * span)
        order = np.argsort((c * groups + g) * size + a % size)
        a, b, w, g, c = (x[order] for x in (a, b, w, g, c))
        ends = np.flatnonzero(np.append((np.diff(g) != 0) | (np.diff(c) != 0), True)) + 1
        for start, end in zip(np.append(0, ends[:-1]), ends):
            for k in range(start, end, PACK // 16):
                s = slice(k, min(k + PACK // 16, end))
                yield _rows([(c[k], g[k], None, _packed(a[s] % size, b[s] % (size * span), w[s]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([_numbers(x) for x in batch.columns])
            n += batch.num_rows
            if n >= PACK:
                yield from pack(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from pack(*map(np.concatenate, zip(*held)))

    return cells.select("a", "b", "w").mapInArrow(run, _TABLE)


def _random(numbers: Numbered, wide: int, seed: int) -> DataFrame:
    """A block with a row of normal numbers for each path, from its name alone."""
    size, span = numbers.size, numbers.span(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int.from_bytes(hashlib.blake2b(f"{seed}:{p}".encode(), digest_size=8).digest(), "little") for p in batch.column(0).to_pylist()]
            y = np.array([np.random.Generator(np.random.Philox(k)).standard_normal(wide) for k in keys]).reshape(-1, wide)
            g, at = np.divmod(_numbers(batch.column(1)), size)
            for own in np.unique(g):
                yield from _pieces(int(own), span, at[g == own], y[g == own])

    return numbers.names.select("path", "number").mapInArrow(run, _TABLE)


def turned(block: DataFrame, by: list[np.ndarray]) -> DataFrame:
    """Block times small matrices, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, g, at, data in zip(*(x.to_pylist() for x in batch.columns)):
                yield _rows([(c, g, at, np.ascontiguousarray(_read(at, data, by)[1]).tobytes())])

    return block.mapInArrow(run, _TABLE) if by else block


def times(cells: DataFrame, block: DataFrame, numbers: Numbered, span: int, wide: int) -> DataFrame:
    """Packed matrix times block. A task holds a span of the block, one group's sums and a few
    thousand cells; a group's sums of all spans meet in a task."""
    size, groups = numbers.size, numbers.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sums = None, None, None  # (span, group) of the sums
        y = np.empty((STEP, wide))  # made once: new memory costs more than the numbers
        for batch in batches:
            for c, g, at, data in zip(*(x.to_pylist() for x in batch.columns)):
                if now and now != (c, g):
                    if sums is not None:
                        yield from sums.pieces(now[1], span)
                    sums = None
                if not now or now[0] != c:
                    held = np.zeros((span * size, wide))
                now = c, g
                if at is not None:  # the block's rows come before cells
                    at, own = _read(at, data, [])
                    held[(g + groups) % span * size + at] = own
                    continue
                sums = sums or _Sums(size, wide)
                i, j, w = _unpacked(data)
                for k in range(0, len(i), STEP):
                    own = held.take(j[k : k + STEP], axis=0, out=y[: len(j) - k], mode="clip")
                    sums.add(i[k : k + STEP], np.multiply(own, w[k : k + STEP, None], out=own))
        if sums is not None:
            yield from sums.pieces(now[1], span)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, _Sums] = {}
        for batch in batches:
            for g, at, data in zip(*(x.to_pylist() for x in batch.columns[1:])):
                at, y = _read(at, data, [])
                own.setdefault(g, _Sums(size, wide)).add(at, y)
        for g, sums in own.items():
            yield from sums.pieces(g, span)

    first = block.withColumn("g", F.col("g") - groups)  # below all groups, so before cells
    met = cells.unionByName(first).repartitionById(-(-groups // span), F.col("c").cast("int")).sortWithinPartitions("c", "g")
    return met.mapInArrow(run, _TABLE).repartitionById(groups, F.col("g").cast("int")).mapInArrow(add, _TABLE)


def product(scratch: Scratch, cells: DataFrame, block: DataFrame, numbers: Numbered, wide: int, by: list[np.ndarray]) -> DataFrame:
    """Packed matrix times (block times ``by``), written; a large block's columns part by part."""
    span, parts = numbers.span(wide), numbers.parts(wide)
    if len(parts) == 1:
        return scratch.cut(times(cells, turned(block, by), numbers, span, wide))
    made = [scratch.cut(times(cells, turned(block, [*by, np.eye(wide)[:, own]]), numbers, span, len(own))) for own in parts]

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, g, at, data in zip(*(x.to_pylist() for x in batch.columns)):
                own, y = _read(at, data, [])
                held.append(y)
                if len(held) == len(parts):
                    yield from _pieces(g, span, own, np.hstack(held))
                    held = []

    # a group's rows are the same in each part, and so are its pieces
    own = [x.withColumns({"c": F.lit(k).cast("long"), "start": F.substring("at", 1, 4)}) for k, x in enumerate(made)]
    met = own[0]
    for x in own[1:]:
        met = met.unionByName(x)
    met = met.repartitionById(numbers.groups, F.col("g").cast("int")).sortWithinPartitions("g", "start", "c").drop("start")
    out = scratch.cut(met.mapInArrow(beside, _TABLE))
    for x in made:
        scratch.drop(x)
    return out


class _Sums:
    """Sums of a group's rows, and which rows there are."""

    def __init__(self, size: int, wide: int):
        self.y, self.met = np.zeros((size, wide)), np.zeros(size, bool)

    def add(self, i: np.ndarray, y: np.ndarray) -> None:
        """``i`` rises."""
        starts = np.flatnonzero(np.append(True, np.diff(i) != 0))
        self.y[i[starts]] += np.add.reduceat(y, starts)
        self.met[i[starts]] = True

    def pieces(self, g: int, span: int) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(self.met)
        return _pieces(g, span, at, self.y[at])


def gram(block: DataFrame, wide: int, by: list[np.ndarray]) -> np.ndarray:
    """The products with each other of the columns of (block times ``by``): a square as wide as the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((wide, wide))
        for batch in batches:
            for at, data in zip(*(x.to_pylist() for x in batch.columns)):
                _, y = _read(at, data, by)
                g += y.T @ y
        i, j = np.indices(g.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(g.ravel())], names=["i", "j", "g"])

    out = np.zeros((wide, wide))
    for r in block.select("at", "data").mapInArrow(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r.i, r.j] = r.g
    return out


def named(block: DataFrame, numbers: Numbered, by: list[np.ndarray]) -> DataFrame:
    """(path, y): the rows of (block times ``by``)."""
    size = numbers.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, at, data in zip(*(x.to_pylist() for x in batch.columns[1:])):
                at, y = _read(at, data, by)
                offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(g * size + at.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=["number", "y"])

    return block.mapInArrow(run, "number long, y array<double>").join(numbers.names, "number").select("path", "y")


def _upright(block: DataFrame, wide: int) -> list[np.ndarray]:
    """Small matrices that turn the block's columns to length one and right angles (directions
    that are none become zero); two, as one leaves rounding behind."""
    by: list[np.ndarray] = []
    for _ in range(2):
        value, vector = np.linalg.eigh(gram(block, wide, by))
        keep = value > value.max(initial=0.0) * 1e-13
        by.append(vector * np.where(keep, 1 / np.sqrt(np.where(keep, value, 1.0)), 0.0))
    return by


def _directions(scratch: Scratch, cells: DataFrame, numbers: Numbered, k: int, spare: int, rounds: int, seed: int) -> tuple[DataFrame, list[np.ndarray], np.ndarray]:
    """(block, by, values) of packed cells: the directions are the rows of (block times ``by``)."""
    wide = k + spare
    block = product(scratch, cells, _random(numbers, wide, seed), numbers, wide, [])
    for _ in range(rounds):
        last, block = block, product(scratch, cells, block, numbers, wide, _upright(block, wide))
        scratch.drop(last)
    by = _upright(block, wide)
    last = product(scratch, cells, block, numbers, wide, by)
    value, vector = np.linalg.eigh(gram(last, wide, []))
    scratch.drop(last)
    scratch.drop(cells)
    first = np.argsort(-value)[:k]
    return block, [*by, vector[:, first]], np.sqrt(np.maximum(value[first], 0.0))


def directions(cells: DataFrame, k: int = 16, spare: int = 16, rounds: int = 3, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """((path, y): the k leading left singular vectors of a symmetric matrix (a, b, w), row by
    row, and the k singular values). ``rounds`` of repeated products sharpen the random start."""
    scratch = Scratch(cells.sparkSession)
    with _released(cells.sparkSession):
        own = scratch.cut(cells)
        numbers = numbered(scratch, own.select(F.explode(F.array("a", "b")).alias("path")).distinct())
        names = numbers.names.select("path", "number")
        met = own.join(names.toDF("a", "i"), "a").join(names.toDF("b", "j"), "b").select(F.col("i").alias("a"), F.col("j").alias("b"), "w")
        cells = scratch.cut(packed(met, numbers, k + spare))
        scratch.drop(own)
        block, by, values = _directions(scratch, cells, numbers, k, spare, rounds, seed)
    return named(block, numbers, by), values


def _margin(reach: int) -> Column:
    """How many visits within reach of this one, before or after, are at another path."""
    order = Window.partitionBy("session").orderBy("place")
    near = [f("path", k).over(order) != F.col("path") for f in (F.lead, F.lag) for k in range(1, reach + 1)]
    return sum(F.when(x, 1).otherwise(0) for x in near)


def margins(seen: DataFrame, reach: int) -> DataFrame:
    """(path, m): the sums of ``pairs(seen, reach)`` by path, counted on the visits themselves."""
    return seen.withColumn("m", _margin(reach)).filter("path is not null").groupBy("path").agg(F.sum("m").alias("m"))


def numbered_cells(seen: DataFrame, names: DataFrame, reach: int) -> DataFrame:
    """``weighed(pairs(seen, reach))`` with numbers for paths, of ``seen`` (session, place, own: number
    and margin). No pairs are joined: margins go with the visits, and a pair is counted one way round."""
    total = names.agg(F.sum("m")).first()[0] or 0
    order = Window.partitionBy("session").orderBy("place")
    ahead = seen.select("own", F.array(*[F.lead("own", k).over(order) for k in range(1, reach + 1)]).alias("ahead"))
    one = ahead.select("own", F.explode("ahead").alias("other")).filter("own.i != other.i")
    one = one.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    one = one.select(F.col("x.i").alias("a"), F.col("x.m").alias("ma"), F.col("y.i").alias("b"), F.col("y.m").alias("mb"))
    counts = one.groupBy("a", "ma", "b", "mb").agg(F.count("*").alias("n"))
    w = F.ln(F.col("n").cast("double") * F.lit(total) / (F.col("ma").cast("double") * F.col("mb")))
    cells = counts.select("a", "b", w.alias("w")).filter("w > 0")
    return cells.select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))


def company_vectors(seen: DataFrame, k: int = 16, reach: int = 5) -> DataFrame:
    """(path, embedding) by co-occurrence: the leading directions, each times the root of its
    singular value. A path without company commoner than chance has none."""
    scratch = Scratch(seen.sparkSession)
    with _released(seen.sparkSession):
        numbers = numbered(scratch, margins(seen, reach))
        own = F.struct(F.col("number").alias("i"), "m").alias("own")
        visited = scratch.cut(seen.join(numbers.names, "path", "left").select("session", "place", own))
        cells = scratch.cut(packed(numbered_cells(visited, numbers.names, reach), numbers, k + 16))
        scratch.drop(visited)
        block, by, values = _directions(scratch, cells, numbers, k, 16, 3, 0)
    return named(block, numbers, [*by, np.diag(np.sqrt(values))]).select("path", F.col("y").alias("embedding"))


def next_recall(seen: DataFrame, near: DataFrame) -> DataFrame:
    """(n, n_found): visits that have a next one in their session at another path, and how many
    of those next paths are among the visited path's neighbours (path, neighbour)."""
    order = Window.partitionBy("session").orderBy("place")
    steps = seen.select("path", F.lead("path").over(order).alias("after")).filter("after is not null and after != path")
    steps = steps.groupBy("path", "after").agg(F.count("*").alias("n"))
    met = steps.join(near.select("path", F.col("neighbour").alias("after"), F.lit(1).alias("hit")).distinct(), ["path", "after"], "left")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("n_found"))
