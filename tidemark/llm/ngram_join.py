"""N-gram Jaccard join: documents whose word shingles overlap, as components.

A document is the set of its word n-grams, hashed once and written to the shared
folder. Two sets with the asked similarity share an n-gram among the first few of
each, whatever order the n-grams have, so only those prefixes are joined. Rare
n-grams come first: frequencies of all documents are counted in a table of fixed
size by hash, and only the order, never the result, depends on it.

Where two prefixes meet, the length and positional filters apply. The suffix
filter then bounds what the sets can share behind the place where they met: the
order is cut into ranges of equal mass, a set's outline says how many of its
n-grams lie in or before each, and no range of both suffixes shares more than the
lesser count. What passes is verified on the whole sets, each pair once.

Of two similar sets the smaller one meets the other at a place that is early even for
sets of its own size, so that a list in which no document has its n-gram so early is
left out. An entry's place also says how large a partner may be: lists are joined by
bands of sizes, and an entry meets only the bands within its reach. Documents that
fill one template and are unlike each other thus don't meet, however many they are.

Equal sets are one class. In each n-gram's list the document that has it first in
its order stands for the others: they are compared with it first, and only documents that are then in
another component than it meet the rest of the list. A group of near copies thus
takes as many comparisons as it has members, yet every link between different
components is found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bloom
from tidemark.llm.common import Cuts, components, slices, small_batches

#: Buckets of the frequency table (a power of two) and ranges of a set's outline.
BUCKETS, OUTLINE = 1 << 20, 64
#: Most words of a filter that spares rows a shuffle (8 MB).
SIEVE_WORDS = 1 << 20
#: Hashes of words that a worker remembers, and n-grams that it orders at once.
REMEMBERED, ORDERED = 200_000, 1 << 19
#: Frequency tables that a task, and the driver, add up.
FAN_IN = 16
#: The sizes of a band differ by less than this ratio.
BAND = 1.06

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; of all words where they are fewer."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def prefix_length(n, percent: int):
    """So many of a set's first elements must hold one of any set that is similar."""
    return np.where(n > 0, n + (-percent * n // 100) + 1, 0)


def lists_of(sizes, flat: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat))


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _hashed(docs: DataFrame, n: int) -> DataFrame:
    """doc, size, two digests and the set of each document; for each task a row with
    its part of the frequency table. The one pass over the texts."""
    long, longs = T.LongType(), T.ArrayType(T.LongType(), False)
    schema = T.StructType([*[T.StructField(c, long) for c in ("doc", "n", "d1", "d2")], T.StructField("elements", longs), T.StructField("counts", T.BinaryType())])
    arrow = pa.schema([*[(c, pa.int64()) for c in ("doc", "n", "d1", "d2")], ("elements", pa.list_(pa.int64())), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(BUCKETS, np.int64), WordHashes()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = [shingles(t, n, known) for t in batch.column(1).slice(a, b - a).to_pylist()]
                flat = np.concatenate(sets)
                np.add.at(counts, bucket(flat), 1)
                digest = np.array([(xxhash.xxh64_intdigest(raw), xxhash.xxh64_intdigest(raw, 1)) for raw in (s.tobytes() for s in sets)], np.uint64).view(np.int64)
                sizes = [len(s) for s in sets]
                columns = [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists_of(sizes, flat), pa.nulls(b - a, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        yield pa.RecordBatch.from_pylist([{"counts": zlib.compress(counts.tobytes(), 1)}], schema=arrow)

    return small_batches(docs).select("doc", "text").mapInArrow(run, schema)


def _total(cuts: Cuts, tables: DataFrame) -> np.ndarray:
    """The sum of the tasks' frequency tables: a tree of tasks that add up ``FAN_IN`` or so,
    the last few on the driver."""

    def add(raws) -> np.ndarray:
        return sum((np.frombuffer(zlib.decompress(raw.as_py()), np.int64) for raw in raws), np.zeros(BUCKETS, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sum((add(batch.column(0)) for batch in batches), np.zeros(BUCKETS, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["counts"])

    left = tables.count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        tables = cuts.cut(tables.repartition(left).mapInArrow(run, "counts binary"))
    return add(tables.toArrow()["counts"])


class Order:
    """The order of all n-grams: by the count of their bucket, then by hash."""

    def __init__(self, counts: np.ndarray):
        each, rank = np.unique(counts, return_inverse=True)
        self.rank = rank.astype(np.min_scalar_type(len(each)))  # tasks get it: mostly 2 MB
        self.mass = (each * np.bincount(rank)).astype(np.uint64)
        self.below = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.mass)[:-1].astype(np.uint64)))
        self.total = max(1, int(self.mass.sum()))

    def sort(self, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets of these sizes, ascending by hash, put in order, and their outlines."""
        owner, rank = np.repeat(np.arange(len(sizes)), sizes), self.rank[bucket(flat)]
        at = np.lexsort((rank, owner))
        # whole numbers only, so that a later n-gram never lies in an earlier range
        place = self.below[rank] + ((self.mass[rank] * (flat >> np.uint64(44))) >> np.uint64(20))
        spot = (place * np.uint64(OUTLINE) // np.uint64(self.total)).astype(np.int64)
        outline = np.bincount(owner * OUTLINE + spot, minlength=OUTLINE * len(sizes)).reshape(len(sizes), OUTLINE)
        return flat[at], np.cumsum(outline, axis=1).astype(np.int32)


def _prefixes(sets: DataFrame, percent: int, order: Order) -> DataFrame:
    """doc, size, digests, outline and prefix, rare first."""
    long = T.LongType()
    fields = [T.StructField(c, long) for c in ("doc", "n", "d1", "d2")]
    schema = T.StructType([*fields, T.StructField("outline", T.ArrayType(T.IntegerType(), False)), T.StructField("prefix", T.ArrayType(long, False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(batch.column(1).to_numpy())
            start = 0
            while start < len(batch):
                done = total[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(total, done + ORDERED, side="right")))
                part = batch.slice(start, end - start)
                start = end
                sizes = part.column(1).to_numpy()
                flat, outline = order.sort(sizes, part.column(4).flatten().to_numpy().view(np.uint64))
                kept = prefix_length(sizes, percent)
                inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                prefix = lists_of(kept, flat[inside < np.repeat(kept, sizes)])
                outlines = lists_of(np.full(len(sizes), OUTLINE), outline.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], outlines, prefix], names=["doc", "n", "d1", "d2", "outline", "prefix"])

    return small_batches(sets).select("doc", "n", "d1", "d2", "elements").mapInArrow(run, schema)


def similar(common: Column, m: Column, n: Column, percent: int) -> Column:
    """Whether ``common`` elements suffice for sets of these sizes."""
    return (100 + percent) * common >= percent * (m + n)


def suffix_bound(oa: Column, p: Column, ob: Column, q: Column) -> Column:
    """Most elements that two sets share which meet first at places p and q: that one,
    and in each range the lesser count of what lies behind."""
    behind = F.zip_with(oa, ob, lambda x, y: F.struct(F.greatest(x, p + 1).alias("x"), F.greatest(y, q + 1).alias("y")))
    start = F.struct(F.lit(1).alias("s"), (p + 1).cast("int").alias("x"), (q + 1).cast("int").alias("y"))

    def add(so_far: Column, to: Column) -> Column:
        more = F.least(to["x"] - so_far["x"], to["y"] - so_far["y"])
        return F.struct((so_far["s"] + more).cast("int").alias("s"), to["x"].cast("int").alias("x"), to["y"].cast("int").alias("y"))

    return F.aggregate(behind, start, add, lambda end: end["s"])


def _meets(m: str, p: str, n: str, q: str, percent: int) -> Column:
    """Length and positional filter of a list's entries of sizes m, n at places p, q.

    The bound holds for the first n-gram that two sets share, and a similar pair
    meets in that one's list."""
    m, p, n, q = map(F.col, (m, p, n, q))
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & similar(F.least(m - p, n - q), m, n, percent)


def reach(n: Column, p: Column, percent: int) -> Column:
    """Largest set that one of size n can be similar to if place p holds the first n-gram they share."""
    return F.floor((100 + percent) * (n - p) / percent).cast("int") - n


def early(n: Column, p: Column, percent: int) -> Column:
    """Whether a set of size n can so meet one of its size or more."""
    return reach(n, p, percent) >= n


def band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("int")


def list_pairs(small: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Meetings (doc, od at places p, op) of entries (gram, doc, n, p, component) of ``small``
    with those of ``large`` in a list, where the first is of the smaller document (ties:
    smaller key), components differ and the length and positional filters pass. The smaller
    one's entry stands in its size's band, the larger one's is asked of each band within its reach."""
    low = F.ceil(percent * F.col("n") / 100)
    far = reach(F.col("n"), F.col("p"), percent)
    s = small.filter(early(F.col("n"), F.col("p"), percent)).withColumn("band", band(F.col("n"))).alias("s")
    l = large.filter(far >= low).withColumn("band", F.explode(F.sequence(band(low), band(F.least(F.col("n"), far))))).alias("l")  # noqa: E741
    order = F.struct("s.n", "s.doc") < F.struct("l.n", "l.doc")
    on = (F.col("s.gram") == F.col("l.gram")) & (F.col("s.band") == F.col("l.band")) & order & (F.col("s.component") != F.col("l.component"))
    met = s.join(l, on & _meets("s.n", "s.p", "l.n", "l.p", percent))
    return met.select(F.col("s.doc").alias("doc"), F.col("l.doc").alias("od"), F.col("s.p").alias("p"), F.col("l.p").alias("op"))


class Join:
    """The tables of one join."""

    def __init__(self, df: DataFrame, n: int, percent: int, text: str, key: str):
        self.cuts, self.percent = Cuts(df.sparkSession), percent
        docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
        hashed = self.cuts.cut(_hashed(docs, n))
        counts = _total(self.cuts, hashed.filter("counts is not null").select("counts"))
        self.rows = hashed.filter("counts is null").select("doc", "n", "d1", "d2")
        self.sets = hashed.filter("counts is null and n > 0 and doc is not null").select("doc", "n", "d1", "d2", "elements")
        firsts = _prefixes(self.sets, percent, Order(counts)).groupBy("d1", "d2").agg(F.min(F.struct("doc", "n", "outline", "prefix")).alias("x")).select("x.*")
        #: the first document of each class
        self.firsts = self.cuts.cut(firsts.withColumn("n", F.col("n").cast("int")))
        self.outlines = self.firsts.select("doc", "n", "outline")
        # a key with several texts has a row for each; copies of a row would be so many more pairs
        self.twice = not self.sets.groupBy("doc").count().filter("count > 1").isEmpty()

    def sieve(self, keys: DataFrame) -> bloom.Bloom:
        return bloom.build(self.cuts, keys, bloom.words_for(keys.count(), 12, SIEVE_WORDS))

    def lists(self) -> DataFrame:
        """gram, doc, n, p of the prefixes' n-grams that several classes have, one of them early,
        and the document ``ld`` that has it at the earliest place ``lp``, ties by hash: one of the many
        members of a group for each n-gram, so that few are left unlike all of them."""
        cut = self.cuts.cut
        soon = early(F.col("n"), F.col("p"), self.percent)
        entries = self.firsts.select("doc", "n", F.posexplode("prefix").alias("p", "gram"))
        several = (F.count("*") > 1) & F.bool_or(soon)
        shared = cut(entries.groupBy("gram").agg(several.alias("several")).filter("several").select("gram"))
        some = cut(entries.filter(self.sieve(shared).passes(F.col("gram"))))
        turn = F.col("p").cast("long") * F.lit(1 << 40) + F.shiftrightunsigned(F.xxhash64("doc", "gram"), 24)
        leads = some.groupBy("gram").agg(F.min_by("doc", turn).alias("ld"), F.shiftright(F.min(turn), 40).cast("int").alias("lp"), several.alias("several"))
        leads = cut(leads.filter("several").drop("several"))
        out = cut(some.join(leads, "gram"))
        self.cuts.drop(shared, some, leads)
        return out

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b and the places p, q where they met first) that the suffix filter lets pass."""
        pairs = given = self.cuts.cut(pairs)
        for side in ("a", "b"):
            pairs = pairs.join(self.outlines.select(F.col("doc").alias(side), F.col("n").alias(f"n{side}"), F.col("outline").alias(f"o{side}")), side)
        bound = suffix_bound(F.col("oa"), F.col("p"), F.col("ob"), F.col("q"))
        out = self.cuts.cut(pairs.filter(similar(bound, F.col("na"), F.col("nb"), self.percent)).select("a", "b").distinct())
        self.cuts.drop(given)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of distinct pairs, by their whole sets."""
        wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
        sets = self.sets.filter(self.sieve(wanted).passes(F.col("doc")))
        if self.twice:
            sets = sets.dropDuplicates(["doc", "d1", "d2"])
        for side in ("b", "a"):
            pairs = pairs.join(sets.select(F.col("doc").alias(side), F.col("elements").alias(f"e{side}")), side)
        common = F.size(F.array_intersect("ea", "eb"))
        return self.cuts.cut(pairs.filter(similar(common, F.size("ea"), F.size("eb"), self.percent)).select("a", "b").distinct())

    def pairs(self, met: DataFrame) -> DataFrame:
        """Distinct pairs a < b of the meetings (doc, od at places p, op)."""
        swap = F.col("doc") > F.col("od")
        ends = (F.least("doc", "od").alias("a"), F.greatest("doc", "od").alias("b"), F.when(swap, F.col("op")).otherwise(F.col("p")).alias("p"), F.when(swap, F.col("p")).otherwise(F.col("op")).alias("q"))
        return met.select(*ends).groupBy("a", "b").agg(F.min("p").alias("p"), F.min("q").alias("q"))


def ngram_links(df: DataFrame, n: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(classes, links): the rows key, class_id of documents with a key and words, and
    a, b of all classes that are linked, by the rule of ``ngram_components``.

    A class is the documents of one set of n-grams, its id the smallest key. Every
    pair of classes that meets in a list is compared, those of one component too, so
    the work grows with the square of a group of near copies, as its links do.
    """
    join = Join(df, n, percent, text, key)
    lists = join.lists()
    lists = lists.withColumn("component", F.col("doc"))
    met = list_pairs(lists, lists, percent)
    links = join.verified(join.filtered(join.pairs(met)))
    fit = join.rows.filter("n > 0 and doc is not null")
    classes = fit.join(fit.groupBy("d1", "d2").agg(F.min("doc").alias("class_id")), ["d1", "d2"])
    return classes.select(F.col("doc").alias(key), "class_id"), links


def ngram_components(df: DataFrame, n: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: the key, n_shingles, component_id.

    Words are what stands between blanks, A-Z lower-cased. Two documents are linked
    where 100 x common n-grams >= ``percent`` x all n-grams of both; component_id is
    the smallest key reachable by links, itself included. A text of fewer than ``n``
    words is one n-gram; null, empty and blank texts have none and link with
    nothing, nor do documents with a null key, whose component_id is null. Repeated
    rows share their component; texts of one key are one document. Texts of any
    length count whole; an empty table gives no rows. Other columns of ``df`` are
    ignored. The key must be an integer.
    """
    join = Join(df, n, percent, text, key)
    cuts, lists = join.cuts, join.lists()
    stars = lists.filter("doc != ld").selectExpr("doc", "ld as od", "p", "lp as op")
    stars = join.filtered(join.pairs(stars))
    links = join.verified(stars)

    found = cuts.cut(components(links, "a", "b"))
    placed = lists.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = placed.join(found.select(F.col("node").alias("ld"), F.col("component").alias("lead")), "ld", "left").withColumn("lead", F.coalesce("lead", "ld"))
    placed = cuts.cut(placed.select("gram", "doc", "n", "p", "component", "lead"))
    odd = cuts.cut(placed.filter("component != lead"))
    beside = placed.filter(join.sieve(odd.select("gram").distinct()).passes(F.col("gram")))
    met = list_pairs(odd, beside, percent).union(list_pairs(beside.filter("component = lead"), odd, percent))
    rest = join.pairs(met).join(stars, ["a", "b"], "left_anti")  # each pair once
    rest = join.verified(join.filtered(rest))

    found = components(links.union(rest), "a", "b")
    classes = join.rows.filter("n > 0 and doc is not null").groupBy("d1", "d2").agg(F.min("doc").alias("node"))
    classes = cuts.cut(classes.join(found, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component")))
    out = join.rows.join(classes, ["d1", "d2"], "left")
    own = F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"))
