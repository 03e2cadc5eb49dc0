"""Runs of words: stretches that repeat themselves with a period, and texts without the repeats.

A run is a stretch of consecutive words in which words ``period`` apart are equal,
that is ``exponent`` periods and ``least`` words long or longer, has no smaller
period, and that neither neighbouring word extends.

Its words from the first to the last but ``period`` stand again ``period`` words
later. That overlap has k words at least, k being the smallest that the two bounds
allow for any period, so every word of a run lies in a k-gram that the document has
twice. All other words are masked, and only what is left between them is searched.
(K-grams are compared by 64-bit hashes; two that collide leave more words in, never
fewer.)

A segment is searched by Main and Lorentz's halving: runs that cross a middle show
in how far the text agrees with itself, onwards and backwards, when moved by each
period, and both lengths of all periods come from Z arrays in linear time. A run that
reaches over the end of its part crosses the middle of a larger one and is found there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_texts

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)),
    T.StructField("collapsed", T.StringType()),
])
#: Parts of so many words are compared with themselves directly.
DIRECT = 32
#: Places of a Z array that are copied one by one.
FEW = 24


def overlap(least: int, exponent: int) -> int:
    """The fewest words that a run shares with itself moved by its period."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def unmasked(words: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Segments (from, to) of words that lie in k-grams which occur twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return
    factors = np.random.default_rng(k).integers(1, 1 << 63, k, np.uint64) | np.uint64(1)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams += words[j : j + n].astype(np.uint64) * factors[j]
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
        first = np.flatnonzero(twice[at] == grams)
        edges = np.zeros(len(words) + 1, np.int32)
        np.add.at(edges, first, 1)
        np.add.at(edges, first + k, -1)
        inside = np.concatenate(([False], np.cumsum(edges) > 0))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        yield from zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)


def agreement(s: np.ndarray, upto: int) -> np.ndarray:
    """Z array: for each place under ``upto`` how many symbols from there equal the first ones.

    What lies in a stretch that is known to equal the beginning is copied from there,
    as many places at once as are known; comparison goes on where a copy ends with the stretch."""
    z, size = np.zeros(max(upto, 1), np.int64), len(s)
    like = np.flatnonzero(s[1:upto] == s[0]) + 1
    left = right = 0
    i = 1
    while i < upto:
        same = 0
        if i < right <= i + FEW:
            same = min(int(z[i - left]), right - i)
            if same < right - i:
                z[i] = same
                i += 1
                continue
        elif i < right:
            n = min(left, right - i, upto - i)
            known, rest = z[i - left : i - left + n], np.arange(right - i, right - i - n, -1)
            open_ = np.flatnonzero(known == rest)
            n = int(open_[0]) if len(open_) else n
            z[i : i + n] = np.minimum(known[:n], rest[:n])
            over = np.flatnonzero(known[:n] > rest[:n])
            if len(over):  # it ends where the stretch does, so it serves as well, and more places are known before it
                left = i + int(over[-1])
            i += n
            if not len(open_):
                continue
            same = right - i
        else:
            at = int(np.searchsorted(like, i))
            if at == len(like):
                break
            i = int(like[at])
        step = 16
        while n := min(step, size - i - same):
            unlike = s[same : same + n] != s[i + same : i + same + n]
            stop = int(unlike.argmax())
            if unlike[stop]:
                same += stop
                break
            same, step = same + n, step * 4
        z[i] = same
        left, right = i, i + same
        i += 1
    return z


def _shifted(near: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each period q from 1 to ``most``, seen from a middle: how long ``near`` (from
    the middle onwards) agrees with itself moved by q, and with what starts q before
    the middle. ``far``: the other side's last ``most`` symbols or fewer."""
    a, b, size = np.zeros(most, np.int64), np.zeros(most, np.int64), len(near)
    z = agreement(np.concatenate((near, far, near)), size + len(far))
    own, other = min(most, size - 1), min(most, len(far))
    a[:own] = np.minimum(z[1 : own + 1], np.arange(size - 1, size - 1 - own, -1))
    b[:other] = np.minimum(z[size:][::-1][:other], size)
    return a, b


def runs_of(x: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers from 0, in order."""
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, q: int) -> None:
        if end - start >= max(least, exponent * q) and (start == 0 or x[start - 1] != x[start - 1 + q]) and (end == len(x) or x[end] != x[end - q]):
            found[start, end] = min(q, found.get((start, end), q))

    parts = [(0, len(x))]
    while parts:
        low, high = parts.pop()
        most = (high - low) // exponent
        if high - low < least or not most:
            continue
        if high - low <= DIRECT:
            for q in range(1, most + 1):
                same = np.concatenate(([False], x[low : high - q] == x[low + q : high], [False]))
                turns = np.flatnonzero(same[1:] != same[:-1])
                for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                    add(low + a, low + b + q, q)
            continue
        middle = (low + high) // 2
        parts += [(low, middle), (middle, high)]
        before, after = x[low:middle][::-1], x[middle:high]
        onwards, ahead = _shifted(after, x[max(low, middle - most) : middle], most)
        backwards, behind = _shifted(before, x[middle : min(high, middle + most)][::-1], most)
        period = np.arange(1, most + 1)
        enough = np.maximum(least, exponent * period) - period
        # the middle and what lies q behind it agree, or it and what lies q before it
        for i in np.flatnonzero((period < len(after)) & (onwards + behind >= enough)).tolist():
            add(middle - int(behind[i]), middle + i + 1 + int(onwards[i]), i + 1)
        for i in np.flatnonzero((period < len(before)) & (backwards + ahead >= enough)).tolist():
            add(middle - i - 1 - int(backwards[i]), middle + int(ahead[i]), i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def search(text: str, least: int, exponent: int, k: int) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the words that no run repeats."""
    words = text.encode().split()  # bytes are split at \x20 and \x09 to \x0D only
    seen: dict[bytes, int] = {}
    x = np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))
    runs = [(a + start, length, q) for a, b in unmasked(x, k) for start, length, q in runs_of(x[a:b], least, exponent)]
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            edges[start + q] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return len(x), runs, b" ".join(words).decode()


def find_runs(docs: DataFrame, text: str = "text", least: int = 6, exponent: int = 4, keep_text: bool = True) -> DataFrame:
    """Append n_words, runs (start, length and period in words, from 0, by start, then
    period) and collapsed: the words outside all runs and of their first periods,
    joined by one blank.

    ``exponent`` periods make a run, a whole number from 2, and ``least`` words. Words
    are ``[^\\x20\\x09-\\x0D]+``. A null text counts as empty; an empty one, or one of blanks, has no words, no runs and
    "" as collapsed. Texts of any length are searched whole, in O(n log n) steps at
    most. Every row is judged by itself, so repeated rows and rows with equal or null
    ids stay as they are; an empty table gives no rows. Columns named like those added,
    in whatever case, are replaced; all others pass.
    """
    if exponent < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    k = overlap(least, exponent)

    def setup():
        def fn(texts: list) -> list:
            found = [search(t or "", least, exponent, k) for t in texts]
            return [[f[0] for f in found], [[{"start": a, "length": b, "period": q} for a, b, q in f[1]] for f in found], [f[2] for f in found]]

        return fn

    return map_texts(docs, text, FOUND, setup, keep_text)
