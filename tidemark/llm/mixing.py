"""Mixing sources to target weights, in shards that each hold their share of every source.

The words of a source, its documents in hash order, are a row of words that is cut into
blocks of equal length (the last is shorter). A source gives its target in words: all
blocks once, then some again, or some of them once; the last block drawn is cut so that
the words come out exactly. So each source has a quota of draws.

Quotas are dealt to the output shards by a splitting tree. A node holds some shards and
the draws that they take together; its left half of the shards takes its number of draws
without replacement, so how many come from each source is multivariate hypergeometric,
and the right half takes the rest. A node's random numbers come from its place alone,
therefore every shard can walk from the root to its leaf by itself, and no quota is lost
or dealt twice. A shard's draws from a source are a range of that source's draws, and a
keyed permutation of the blocks says which block each draw is: ranges are disjoint, so
are the blocks of a pass. Draws are then shuffled within their shard by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Cuts

#: Weights of the sources in order, again and again.
WEIGHTS = (3, 1, 2)
#: Words of a block, and draws in a shard; blocks get longer where there would be more than MOST_DRAWS.
BLOCK_WORDS, SHARD_DRAWS, MOST_DRAWS = 256, 4096, 500_000_000
#: Documents of a source that are put in order together.
TOGETHER = 1024
#: Sources whose quotas are broadcast (32 MB); those of more are shuffled to the tasks that deal.
BROADCAST_SOURCES = 1 << 20
#: Bits of a document's place in its source.
KEY_BITS = 48
#: Rounds of the keyed permutation.
ROUNDS = 6


def _mixed(*parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(",".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


class Permutation:
    """A keyed bijection of 0 .. n - 1, computed place by place: a Feistel network over
    the next larger power of four, applied until the result is in range."""

    def __init__(self, n: int, *key: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(_mixed(r, *key)) for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> shift, x & mask
        for key in reversed(self.keys) if back else self.keys:
            a, b = (b ^ self._round(a, key), a) if back else (b, a ^ self._round(b, key))
        return a << shift | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.uint64).copy()
        out = np.arange(len(x))
        while len(out):
            x[out] = self._once(x[out], back)
            out = out[x[out] >= self.n]
        return x.astype(np.int64)

    def place(self, block: np.ndarray) -> np.ndarray:
        return self._walk(block, False)

    def block(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, True)


class Draws:
    """The draws of one source: ``n`` blocks of ``length`` words, ``size`` words in all, of
    which ``quota`` words are wanted, at most ``passes`` times ``size``."""

    def __init__(self, source: int, size: int, quota: int, length: int, seed: int):
        self.n, self.length, self.last = -(-size // length), length, size - (-(-size // length) - 1) * length
        self.passes = []
        for k in range(-(-quota // size) if size else 0):
            wanted = min(size, quota - k * size)
            order = Permutation(self.n, seed, source, k)
            short = int(order.place(np.array([self.n - 1]))[0])
            many = -(-wanted // length)
            many += self._before(many, short) < wanted
            self.passes.append((order, short, wanted, many))
        self.many = sum(p[3] for p in self.passes)

    def _before(self, places, short: int):
        """Words in the blocks at the places before."""
        return places * self.length - (places > short) * (self.length - self.last)

    def range(self, first: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, words taken of its beginning) of draws ``first`` and following."""
        blocks, words, start = [], [], 0
        for order, short, wanted, many in self.passes:
            place = np.arange(max(first - start, 0), min(first + number - start, many), dtype=np.int64)
            if len(place):
                block = order.block(place)
                blocks.append(block)
                words.append(np.minimum(np.where(block == self.n - 1, self.last, self.length), wanted - self._before(place, short)))
            start += many
        none = np.zeros(0, np.int64)
        return (np.concatenate(blocks), np.concatenate(words)) if blocks else (none, none)


def deal(quotas: np.ndarray, shards: int, low: int, high: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first draw, number of draws), the latter for each source, of the shards from
    ``low`` to ``high``: their walks from the root of the splitting tree."""
    total = int(quotas.sum())
    upto = lambda shard: total * shard // shards
    nodes = [(0, shards, np.zeros_like(quotas), quotas)]
    while nodes:
        a, b, first, held = nodes.pop()
        if b - a == 1:
            yield a, first, held
            continue
        middle = (a + b) // 2
        rng = np.random.Generator(np.random.Philox(_mixed(seed, shards, a, b)))
        left = rng.multivariate_hypergeometric(held, upto(middle) - upto(a), method="marginals")
        if high > middle:
            nodes.append((middle, b, first + left, held - left))
        if low < middle:
            nodes.append((a, middle, first, left))


def _ordered(names: DataFrame, cuts: Cuts) -> DataFrame:
    """Append number: the place of each source by code point from 0, null last. Sorted in
    ranges, each counted by itself; only the ranges' counts meet."""
    rows = cuts.cut(names.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.withColumn("part", part).join(before, "part").withColumn("number", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Append number, weight and target to (source, source_size).

    ``share`` of all sizes is dealt by weight. A target over ``most`` times its source's
    size stops there and what is over goes to those under it, by weight, until none is
    over; each time is one aggregate over the sources. If all stop, so be it."""
    cuts = Cuts(sizes.sparkSession)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = cuts.cut(_ordered(sizes, cuts).withColumn("weight", weight))
    size, capped, level = F.col("source_size").cast("double"), -1, 0.0
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("weight") * level >= most * size if capped >= 0 else F.lit(False)
        held, free, n = rows.agg(F.sum(F.when(full, most * size).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == capped:
            return rows.withColumn("target", F.when(full, most * size).otherwise(F.col("weight") * level))
        capped, level = n, (share * total - held) / free if free else level


def _thin(docs: DataFrame, source: str, seed: int) -> DataFrame:
    """doc_id, source, size and key of each document: no text goes further."""
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    return docs.select("doc_id", F.col(source).cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), key.alias("key"))


def _placed(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Append start: the words before a document in its source, in order of its hash.

    A source is cut by hash into parts of about TOGETHER documents, so that one with a
    third of all rows is summed by many tasks; the parts' sums are summed likewise."""
    width = F.lit(float(1 << KEY_BITS)) / F.greatest(F.lit(1.0), F.col("n_docs") / TOGETHER)
    rows = rows.join(totals, rows["source"].eqNullSafe(totals["source"])).drop(totals["source"])
    rows = rows.withColumn("part", F.floor(F.shiftrightunsigned("key", 64 - KEY_BITS) / width).cast("long"))
    sums = rows.groupBy("number", "part").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("chunk", F.floor(F.col("part") / TOGETHER))
    chunks = sums.groupBy("number", "chunk").agg(F.sum("words").alias("words"))
    chunks = chunks.select("number", "chunk", (F.sum("words").over(Window.partitionBy("number").orderBy("chunk")) - F.col("words")).alias("chunk_start"))
    inside = F.sum("words").over(Window.partitionBy("number", "chunk").orderBy("part")) - F.col("words")
    starts = sums.withColumn("inside", inside).join(chunks, ["number", "chunk"]).select("number", "part", (F.col("chunk_start") + F.col("inside")).alias("part_start"))
    own = Window.partitionBy("number", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(own))
    return rows.join(starts, ["number", "part"]).withColumn("start", F.col("part_start") + F.col("upto") - F.col("size")).drop("part", "upto", "part_start", "n_docs")


class Mix:
    """What a mix takes, decided for all documents; see ``mix``."""

    def __init__(self, docs: DataFrame, share: float, most: int, weights: tuple[float, ...], source: str, seed: int, block_words: int, shard_draws: int):
        spark = docs.sparkSession
        self.docs, self.seed, self.cuts = docs, seed, Cuts(spark)
        thin = self.cuts.cut(_thin(docs, source, seed))
        sums = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
        self.sources = self.cuts.cut(targets(sums, share, most, weights).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")))
        self.words = self.sources.agg(F.sum("quota")).first()[0] or 0
        self.length = block_words
        while self.words / self.length > MOST_DRAWS:
            self.length *= 2
        self.placed = self.cuts.cut(_placed(thin, self.sources.drop("weight", "quota")))
        self.cuts.drop(thin)
        self.shards = max(1, round(self.words / self.length / shard_draws))
        self.drawn = self.cuts.cut(self._draws(self._dealt()))

    def _dealt(self) -> DataFrame:
        """(number, source_size, quota, shard, first, many) of every shard and source that it draws from."""
        seed, length, shards, rows = self.seed, self.length, self.shards, 8

        def quotas(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                yield pdf.assign(draws=[Draws(int(n), int(s), int(q), length, seed).many for n, s, q in zip(pdf.number, pdf.source_size, pdf.quota, strict=True)])

        def walks(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for low, all_ in zip(pdf.low, pdf["all"], strict=True):
                    table = np.array([[r["number"], r["source_size"], r["quota"], r["draws"]] for r in all_], np.int64)
                    for shard, first, many in deal(table[:, 3], shards, low, min(low + rows, shards), seed):
                        some = np.flatnonzero(many)
                        yield pd.DataFrame({"number": table[some, 0], "source_size": table[some, 1], "quota": table[some, 2], "shard": shard, "first": first[some], "many": many[some]})

        counted = self.sources.select("number", "source_size", "quota").filter("quota > 0").mapInPandas(quotas, "number long, source_size long, quota long, draws long")
        # the quotas of all sources in one row, 32 bytes a source, go to every task that deals
        gathered = counted.agg(F.sort_array(F.collect_list(F.struct("number", "source_size", "quota", "draws"))).alias("all")).filter(F.size("all") > 0)
        tasks = self.docs.sparkSession.range(0, shards, rows, max(1, min(2000, -(-shards // rows)))).withColumnRenamed("id", "low")
        met = tasks.crossJoin(F.broadcast(gathered)) if self.sources.count() <= BROADCAST_SOURCES else tasks.crossJoin(gathered).repartition("low")
        return met.mapInPandas(walks, "number long, source_size long, quota long, shard long, first long, many long")

    def _draws(self, dealt: DataFrame) -> DataFrame:
        """(number, block, words, shard, slot): every draw, and its place in its shard."""
        seed, length = self.seed, self.length

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: dict[tuple[int, int, int], Draws] = {}
            for pdf in pdfs:
                for number, size, quota, shard, first, many in pdf.itertuples(index=False):
                    if (number, size, quota) not in kept:
                        kept = {(number, size, quota): Draws(number, size, quota, length, seed)}
                    block, words = kept[number, size, quota].range(first, many)
                    order = [_mixed(seed, number, d) >> 1 for d in range(first, first + many)]
                    yield pd.DataFrame({"number": number, "block": block, "words": words, "shard": shard, "slot": order})

        return dealt.mapInPandas(run, "number long, block long, words long, shard long, slot long")

    def _met(self, *carried: str) -> DataFrame:
        """What each draw takes of each document, with the columns carried."""
        length = self.length
        blocks = F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length)))
        pieces = self.placed.filter("size > 0").select("number", "start", "size", blocks.alias("block"), "doc_id", *carried)
        begin = F.greatest(F.col("start"), F.col("block") * length)
        end = F.least(F.col("start") + F.col("size"), F.col("block") * length + F.col("words"))
        met = pieces.join(self.drawn, ["number", "block"]).withColumns({"from_word": begin - F.col("start"), "n_words": end - begin})
        return met.filter("n_words > 0")

    def spans(self) -> DataFrame:
        """(shard, slot, doc_id, key, number, start, from_word, n_words): what each draw takes
        of each document; by shard and slot, then start, in the order of the mix.

        Documents' pieces and draws are both dealt by source and block, so a source with a
        third of all rows is spread as the others are."""
        return self._met("key").select("shard", "slot", "doc_id", "key", "number", "start", "from_word", "n_words")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and taken of every document."""
        columns, none = ["doc_id", "size", "source_size", "target"], F.lit(0).cast("long").alias("taken")
        full = self.placed.filter("size > 0").select("number", "start", *columns, none)
        full = full.unionByName(self._met("source_size", "target").select("number", "start", *columns, F.col("n_words").alias("taken")))
        # a start is one document's alone, but for those without words
        full = full.groupBy("number", "start", *columns).agg(F.sum("taken").alias("taken"))
        return full.select(*columns, "taken").unionByName(self.placed.filter("size = 0").select(*columns, none))

    def texts(self) -> DataFrame:
        """(shard, slot, doc_id, from_word, n_words, text) of all the mix, each shard sorted
        within its partition: the words of a span joined by one blank. Every text moves once."""

        def cut(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for doc_id, text, spans in pdf.itertuples(index=False):
                    words, out = text.encode().split(), pd.DataFrame([dict(zip(names, s, strict=True)) if isinstance(s, tuple) else s for s in spans])
                    yield out.assign(doc_id=doc_id, text=[b" ".join(words[a : a + n]).decode() for a, n in zip(out.from_word, out.n_words, strict=True)])

        names = ("shard", "slot", "start", "from_word", "n_words")
        spans = self.spans().groupBy("doc_id", "key").agg(F.collect_list(F.struct(*names)).alias("spans"))
        whole = self.docs.select(F.col("doc_id").alias("__id"), F.xxhash64(F.lit(self.seed), "doc_id", "text").alias("__key"), "text").dropDuplicates(["__id", "__key"])
        met = spans.join(whole, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "spans")
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        out = met.mapInPandas(cut, f"shard long, slot long, start long, from_word long, n_words long, doc_id {kind}, text string")
        return out.repartition("shard").sortWithinPartitions("shard", "slot", "start").select("shard", "slot", "doc_id", "from_word", "n_words", "text")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS, source: str = "source", seed: int = 0, block_words: int = BLOCK_WORDS, shard_draws: int = SHARD_DRAWS) -> Mix:
    """Decide a mix of ``docs`` (doc_id, text and a source): ``share`` of all words, dealt to
    the sources by weight.

    A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``, a null text's is 0.
    Sources are ordered by code point, null being one of its own and last; ``weights`` go
    round. A target is at most ``most`` times its source's size, and so is what is taken of
    any document. The words taken of a source are its target to the nearest whole word.
    Documents of any length are cut into blocks, so a very long one is no lump. Repeated
    rows count each for itself; among rows alike in id and text it is the same which of
    them was taken. Null ids are ids. A source without words gives none; an empty table
    gives no rows. Columns besides the three are not read, whatever their names. The same
    documents and seed give the same mix, however they are partitioned.

    The result's ``taken`` has a row for each document, ``spans`` what each draw takes,
    and ``texts`` the mixed shards.
    """
    return Mix(docs, share, most, weights, source, seed, block_words, shard_draws)
