"""URL rules and an exact Bloom filter cascade over a corpus's keys.

A Bloom filter of the listed keys also passes some unlisted ones. When the whole
universe of keys is known, those false positives can be listed in a second
filter, the listed keys that the second one passes wrongly in a third, and so on
until a level passes nothing wrongly. For every key of the universe the number
of levels that it passes then tells membership exactly, by bit tests alone: the
pages are neither shuffled nor joined.

The first level is as wide as lets about as many unlisted keys pass as are listed, so
the later ones grow with the list and not with the universe.

A list of any length is decided so. Beyond ``PART_KEYS`` listed keys, or as many words
of a first level as those need at 8 bits, the range of the keys' hashes is cut into
parts, and each part has a cascade and a pass over the pages of its own, so that no
task holds more than one part's tables.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.common import Cuts, ascii_lower, unused

#: Listed keys of a cascade, and bits of its first level over 8: 16 MB.
PART_KEYS = 1 << 24


@dataclass(frozen=True)
class Cascade:
    """Levels, alternately of listed keys and of wrongly passed others."""

    levels: tuple[bloom.Bloom, ...]

    def listed(self, key: Column) -> Column:
        """True where the key is listed; exact for keys of the universe; null is not listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(self.levels[depth].passes(key), verdict).otherwise(F.lit(depth % 2 == 1))
        return F.when(key.isNull(), F.lit(False)).otherwise(verdict)


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: float = 8.0) -> Cascade:
    """Cascade over ``universe`` for the keys of ``listed`` (both: a column ``key``).

    Nulls and repeats are ignored; a listed key outside the universe counts as
    part of it. An empty list gives a cascade without levels: nothing is listed.
    """
    cuts = Cuts(universe.sparkSession)
    yes = cuts.cut(listed.select("key").filter("key is not null").distinct())
    no = cuts.cut(universe.select("key").filter("key is not null").distinct().join(yes, "key", "left_anti"))
    levels: list[bloom.Bloom] = []
    inside, outside, others = yes, no, no.count()
    while n := inside.count():
        level = bloom.build(cuts, inside, bloom.words_sieving(n, others, bits_per_key), salt=len(levels))
        levels.append(level)
        inside, outside, others = cuts.cut(outside.filter(level.passes(F.col("key")))), inside, n
    return Cascade(tuple(levels))


def mark_listed(df: DataFrame, key: Column, name: str, listed: DataFrame, part_keys: int = PART_KEYS) -> DataFrame:
    """Append ``name``: whether ``key`` is among ``listed`` (column ``key``).

    A pass over ``df`` for each ``part_keys`` listed keys, or 8 times as many bits of a
    first level (the rows of ``df`` bound its keys)."""
    cuts = Cuts(df.sparkSession)
    listed = cuts.cut(listed.select("key").filter("key is not null").distinct())
    n = listed.count()
    parts = max(1, -(-n // part_keys), -(-64 * bloom.words_sieving(n, df.count(), 8.0) // max(64, 8 * part_keys)) if n else 1)
    part = lambda k: F.pmod(F.xxhash64(F.lit(-1), k), F.lit(parts))
    universe = df.select(key.alias("key")).filter("key is not null").distinct()
    if parts == 1:
        return df.withColumn(name, build_cascade(listed, universe).listed(key))
    universe, out = cuts.cut(universe), df.withColumn(name, F.lit(False))
    for p in range(parts):
        mine = part(F.col("key")) == p
        cascade = build_cascade(listed.filter(mine), universe.filter(mine))
        out = cuts.cut(out.withColumn(name, F.when(key.isNotNull() & (part(key) == p), cascade.listed(key)).otherwise(F.col(name))))
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Null or
    no ``://``: both empty."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    ``rules``: (verdict, host, path), any number. A rule fits its host and all its
    subdomains where the url's path starts with the rule's. Among equally long rules
    the first given wins. The rules stand in an index by the hash of their host, a
    single literal of the plan; a url looks up the endings of its host that have no
    more labels than a rule's.
    """
    width = max(1, len(rules))
    index: list[list[dict]] = [[] for _ in range(width)]
    for i, (says, h, p) in enumerate(rules):
        index[zlib.crc32(h.encode()) % width].append({"n": len(h) + len(p), "i": -i, "says": says, "host": h, "path": p})
    table = F.from_json(F.lit(json.dumps(index)), "array<array<struct<n:int,i:int,says:string,host:string,path:string>>>")
    labels = F.split(host, r"\.", -1)
    deepest = max([h.count(".") + 1 for _, h, _ in rules], default=1)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    fits = lambda end: F.filter(F.get(table, F.pmod(F.crc32(end.cast("binary")), F.lit(width)).cast("int")), lambda r: (r["host"] == end) & F.startswith(path, r["path"]))
    best = F.array_max(F.flatten(F.transform(ends, fits)))
    return F.concat(best["host"], best["path"]), best["says"]


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", part_keys: int = PART_KEYS) -> DataFrame:
    """Append host, path, rule and verdict to ``pages``.

    ``listed``: hosts (column ``key``), any number, that are blocked where no rule
    fits. A null or empty url, or one without a host, is allowed unless a rule or
    the list names the empty host. Urls of any length are taken whole. Columns of
    the same names are replaced, all others pass; rows keep their number, repeated
    ones included. No pages give no rows; an empty list blocks nothing.
    """
    host, path = split_url(F.col(url))
    base = pages.withColumns({"host": host, "path": path})
    says, hit = unused(pages, "says", "hit")
    base = base.withColumns(dict(zip(("rule", says), rule_of(F.col("host"), F.col("path"), rules), strict=True)))
    out = mark_listed(base, F.col("host"), hit, listed, part_keys)
    return out.withColumn("verdict", F.coalesce(says, F.when(F.col(hit), F.lit("block")).otherwise(F.lit("allow")))).drop(says, hit)


def hosts_named(pages: DataFrame, terms: tuple[str, ...], url: str = "url") -> DataFrame:
    """A host list (column ``key``): the hosts of ``pages`` with one of the terms in them."""
    host = split_url(F.col(url))[0]
    return pages.select(host.alias("key")).filter(reduce(lambda a, b: a | b, [F.col("key").contains(t) for t in terms])).distinct()
