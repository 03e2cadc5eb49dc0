"""Benchmark decontamination by Wu-Manber search over words.

Every run of ``window`` words of a benchmark item is a test string; an item of
fewer words is one whole. For test strings of one length a shift table tells,
for the block of words that ends at a position, how far the next possible end of
a test string lies; most positions are skipped. Where the shift is zero, the
block's hash selects the bucket of test strings that end so, a second key their
beginning, and comparing word for word confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Cuts, map_texts, unused

#: Bytes of benchmark text searched for in one pass; a larger benchmark takes more passes.
BLOCK_BYTES = 16 << 20

#: First words of a test string that a bucket is sorted by, and their hash's factor and bits.
PREFIX, MIX, BITS = 4, 0x9E3779B1, (1 << 62) - 1

#: Bytes to words: A-Z in lower case; ASCII other than letters and digits is a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


#: Searchers that this worker has made, by the digest of their block of the benchmark.
_MADE: dict[bytes, Block] = {}


class Searcher:
    """Test strings of one length in Wu-Manber tables.

    Words are numbers here, equal for equal words only. ``shift`` and ``heads`` are
    indexed by a block's hash: blocks that fall together get the least shift of all
    and share a bucket, which costs time and never an occurrence. A bucket is a
    stretch of ``places``, sorted by ``prefix``, a hash of the first words: where in the
    benchmark's words a test string starts;
    equal strings have one, with all their items."""

    def __init__(self, length: int, words: list[int], starts: np.ndarray, owner: np.ndarray):
        ids = np.array(words, np.int64)
        self.length, self.block, self.words = length, min(2, length), words
        key = np.zeros(len(starts), np.uint64)
        for j in range(length):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[starts + j].astype(np.uint64)
        order = np.lexsort((owner, starts, key))
        starts, owner, key = starts[order], owner[order], key[order]
        new = np.ones(len(starts), bool)
        new[1:] = key[1:] != key[:-1]
        for j in range(length):  # the same key, the same words: else a string of its own
            new[1:] |= ids[starts[1:] + j] != ids[starts[:-1] + j]
        first = np.flatnonzero(new)
        self.owner, self.bounds = owner.astype(np.int32), np.append(first, len(starts)).astype(np.int32)
        places = starts[first]
        self.mask = (1 << max(10, int(2 * len(places)).bit_length())) - 1
        far = min(255, length - self.block + 1)
        shift = np.full(self.mask + 1, far, np.uint8)
        for end in range(self.block, length + 1):
            shift[self._spots(ids, places, end)] = min(far, length - end)
        last = self._spots(ids, places, length)
        self.lead = min(PREFIX, length)
        prefix = np.zeros(len(places), np.int64)
        for j in range(self.lead):
            prefix = prefix * MIX + ids[places + j] & BITS  # wrapping leaves the low bits as they are
        order = np.lexsort((prefix, last))
        self.shift, self.prefix = shift.tobytes(), array("q", prefix[order].tobytes())
        self.places, self.string = array("i", places[order].astype(np.int32).tobytes()), array("i", order.astype(np.int32).tobytes())
        heads = np.zeros(self.mask + 2, np.int32)
        np.cumsum(np.bincount(last, minlength=self.mask + 1), out=heads[1:], dtype=np.int32)
        self.heads = array("i", heads.tobytes())

    def _spots(self, ids: np.ndarray, places: np.ndarray, end: int) -> np.ndarray:
        at = ids[places + end - 1]
        return ((ids[places + end - 2] * 0x9E3779B1 + at if self.block == 2 else at * 0x9E3779B1) >> 3 ^ at) & self.mask

    def items(self, string: int) -> list[int]:
        return self.owner[self.bounds[string] : self.bounds[string + 1]].tolist()

    def alike(self, spot: int, first: list[int]) -> tuple[int, int]:
        """Range of a bucket's strings whose first words have the hash of these."""
        key = 0
        for n in first:
            key = key * MIX + n & BITS
        high = self.heads[spot + 1]
        low = bisect_left(self.prefix, key, self.heads[spot], high)
        return low, bisect_right(self.prefix, key, low, high) if low < high and self.prefix[low] == key else low

    def find(self, ids: list[int]) -> Iterable[tuple[int, int]]:
        """(start, string) of every occurrence, in order; ids are -1 for words that the benchmark lacks."""
        length, shift, two, mask, known = self.length, self.shift, self.block == 2, self.mask, self.words
        at, n = length - 1, len(ids)
        while at < n:
            b = ids[at]
            if b < 0:  # no test string has it
                at += length
                continue
            if two:
                a = ids[at - 1]
                if a < 0:
                    at += length - 1
                    continue
                spot = (a * 0x9E3779B1 + b >> 3 ^ b) & mask
            else:
                spot = (b * 0x9E3779B1 >> 3 ^ b) & mask
            step = shift[spot]
            if step:
                at += step
                continue
            start = at - length + 1
            for k in range(*self.alike(spot, ids[start : start + self.lead])):
                place = self.places[k]
                if known[place : place + length] == ids[start : at + 1]:
                    yield start, self.string[k]
                    break
            at += 1


class Block:
    """A block of the benchmark: the numbers of its words and a searcher for each length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        words: list[int] = []
        starts: dict[int, list[np.ndarray]] = {}
        owner: dict[int, list[np.ndarray]] = {}
        for i, (_, text) in enumerate(items):
            own = [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
            length = min(window, len(own))
            if length:
                at = np.arange(len(words), len(words) + len(own) - length + 1)
                starts.setdefault(length, []).append(at)
                owner.setdefault(length, []).append(np.full(len(at), i))
                words += own
        self.searchers = [Searcher(n, words, np.concatenate(starts[n]), np.concatenate(owner[n])) for n in sorted(starts)]

    def search(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Merged word ranges of all occurrences, and the names of the items, sorted."""
        ids = list(map(self.numbers.get, words, repeat(-1)))
        found, strings = [], set()
        for s in self.searchers:
            for start, string in s.find(ids):
                found.append((start, start + s.length))
                strings.add((s.length, string))
        merged: list = []
        for start, end in sorted(found):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        by_length = {s.length: s for s in self.searchers}
        which = {i for length, string in strings for i in by_length[length].items(string)}
        return merged, sorted({self.names[i] for i in which if self.names[i] is not None})


def block_of(items: list[tuple[str, str | None]], window: int) -> Block:
    """The block's tables, made once in a worker and kept until it gets another block."""
    mark = hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).digest()
    if mark not in _MADE:
        _MADE.clear()
        _MADE[mark] = Block(items, window)
    return _MADE[mark]


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[tuple[list[tuple[str, str | None]], bool]]:
    """(items, whether more follow) of blocks of about so many bytes, one item at least; one empty block for no items."""
    held, size = [], 0
    for item, words, n in benchmark.select(F.col(item_id).cast("string"), text, F.coalesce(F.octet_length(text), F.lit(0))).toLocalIterator():
        if held and size + n > limit:
            yield held, True
            held, size = [], 0
        held.append((item, words))
        size += n
    yield held, False


def _searched(df: DataFrame, text: str, items: list, window: int, names: tuple[str, str, str], keep_text: bool) -> DataFrame:
    span = T.ArrayType(T.ArrayType(T.IntegerType(), False), False)
    added = T.StructType([T.StructField(names[0], T.LongType()), T.StructField(names[1], span), T.StructField(names[2], T.ArrayType(T.StringType()))])

    def setup():
        block = block_of(items, window)

        def fn(texts: list) -> list:
            rows = []
            for t in texts:
                split = words_of(t)
                rows.append((len(split), *block.search(split)))
            return list(map(list, zip(*rows, strict=True)))

        return fn

    return map_texts(df, text, added, setup, keep_text)


def find_overlap(df: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """Append n_words, n_hit, items and spans to ``df``.

    n_words: words of the text; n_hit: those inside any occurrence of a test
    string; items: ids (as strings, sorted) of the items with an occurrence; spans:
    word ranges [start, end) of occurrences, merged within a pass. Null and empty
    texts have no words and hit nothing; an empty benchmark hits nothing, and an empty
    table gives no rows. Texts of any length are searched whole. Repeated items count
    once, items with a null id hit but aren't listed. Columns of the same names are
    replaced, all others pass. Documents neither move nor merge.

    The benchmark comes to the driver a block of ``block_bytes`` at a time, and each
    block takes a pass over the documents; between passes they are written to the
    shared folder, so that no more than one block is anywhere at once.
    """
    cuts, out, held = Cuts(df.sparkSession), df, df
    spans, items, words = unused(df, "spans", "items", "words")
    for k, (block, more) in enumerate(blocks(benchmark, item_id, item_text, block_bytes)):
        names = (words, f"{spans}{k % 2}", f"{items}{k % 2}")
        out = _searched(out, text, block, window, names, keep_text or more)
        if k:
            old = [f"{what}{(k + 1) % 2}" for what in (spans, items)]
            out = out.withColumns({names[1]: F.concat(names[1], old[0]), names[2]: F.array_union(names[2], old[1])}).drop(*old)
        if more:
            last, held = held, cuts.cut(out)
            out = held
            cuts.drop(last)
    places = F.flatten(F.transform(names[1], lambda s: F.sequence(s[0], s[1] - 1)))
    n_hit = F.size(F.array_distinct(places) if k else places).cast("long")
    out = out.withColumns({"n_words": F.col(words), "n_hit": n_hit, "items": F.array_sort(F.col(names[2])), "spans": F.col(names[1])})
    return out.drop(*names)


def contaminated(n_words: Column, n_hit: Column, one_in: int = 20) -> Column:
    """Something is hit, and at least one word in ``one_in``."""
    return (n_hit > 0) & (one_in * n_hit >= n_words)
