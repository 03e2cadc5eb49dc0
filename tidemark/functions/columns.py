"""Column functions that other engines can reproduce bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(value: Column, hex_digits: int, buckets: int) -> Column:
    """Bucket of a value by the leading hex digits of its text's SHA-256."""
    return F.pmod(F.conv(F.left(F.sha2(value.cast("string"), 256), F.lit(hex_digits)), 16, 10).cast("long"), F.lit(buckets))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"://([^/]*)", 1)


def first_segment(url: Column) -> Column:
    return F.regexp_extract(url, r"://[^/]*/([^/?#]*)", 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def seconds(later: Column, earlier: Column) -> Column:
    """Difference of two timestamps in seconds."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6
