"""Bloom filters that Spark itself builds and probes, with built-in functions only.

A key sets ``BITS`` bits of one 64-bit word of the table (blocked filters, Putze et
al. 2007). An aggregation makes the words, which are written as one row to the
shared folder; a scalar subquery reads it once for each query and is a single
node of the plan, whatever the table's size. A filter never misses a key that it
holds; with 8 bits for each key it passes about one in twenty others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Cuts

#: Bits that a key sets.
BITS = 4
#: Words of a piece of the table, as a power of two: what one row of its building holds.
PIECE = 12


def words_for(n: int, bits_per_key: float, most: int) -> int:
    """Words of a table for ``n`` keys, ``most`` at most."""
    return max(1, min(most, -(-int(n * bits_per_key) // 64)))


def passed(n: int, words: int) -> float:
    """The share of other keys that a table of so many words with ``n`` keys passes, about."""
    mean = n / words
    most = int(mean + 12 * math.sqrt(mean) + 12)
    chance = (math.exp(j * math.log(mean) - mean - math.lgamma(j + 1)) for j in range(1, most + 1))
    return sum(c * (1 - (1 - 1 / 64) ** (BITS * j)) ** BITS for j, c in enumerate(chance, 1))


def words_sieving(n: int, others: int, bits_per_key: float, few: int = 1024) -> int:
    """Words for ``n`` keys so that, of so many others, about ``n`` or ``few`` pass at
    most: some bits more a key each time that the others double."""
    words = words_for(n, bits_per_key, 1 << 62)
    while n and passed(n, words) * others > max(n, few):
        words += max(1, words // 4)
    return words


def _spot(key: Column, words: int, salt: int) -> tuple[Column, Column]:
    """(word, mask) of a key."""
    bits = F.xxhash64(F.lit(2 * salt + 1), key)
    mask = F.lit(0).cast("long")
    for j in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * j).bitwiseAND(63).cast("int")))
    return F.pmod(F.xxhash64(F.lit(2 * salt), key), F.lit(words)), mask


@dataclass(frozen=True)
class Bloom:
    """A table of ``words`` words; ``salt`` picks its hash functions."""

    words: int
    salt: int
    table: DataFrame

    def passes(self, key: Column) -> Column:
        word, mask = _spot(key, self.words, self.salt)
        piece = F.get(self.table.scalar(), F.shiftright(word, PIECE).cast("int"))
        return F.get(piece, word.bitwiseAND((1 << PIECE) - 1).cast("int")).bitwiseAND(mask) == mask


def build(cuts: Cuts, keys: DataFrame, words: int, salt: int = 0) -> Bloom:
    """A filter that holds all of ``keys`` (one column). It has ``words`` words however
    many keys there are: with too few it passes more, and never drops one."""
    word, mask = _spot(F.col(keys.columns[0]), words, salt)
    blank = keys.sparkSession.range(words).selectExpr("id as w", "0L as b")
    rows = keys.select(word.alias("w"), mask.alias("b")).unionByName(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    rows = rows.groupBy(F.shiftright("w", PIECE).alias("w")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("b"))
    return Bloom(words, salt, cuts.cut(rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("table"))))
