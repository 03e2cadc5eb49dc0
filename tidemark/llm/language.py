"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text of each language holds all its substrings. A
text is parsed against it into the longest matches from left to right (Ziv and
Merhav 1993); text of the same language needs few phrases. The phrases, each
worth the bits of a position in that language's text, are counted per character,
and the language with the fewest wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_texts

#: Characters of labelled text for each language, and for all together.
SAMPLE_CHARS, ALL_CHARS = 32_768, 1 << 18
#: Columns of the transition tables: the commonest characters, any other. Others of
#: the samples have codes from CLASSES on, and their transitions are kept sparse.
CLASSES = 64
#: Characters of the stretches that are parsed side by side.
STRETCH = 512
UNKNOWN = "und"

PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def plain(text: str) -> str:
    """Lower case, every stretch of other than letters a single blank."""
    out = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTERS[np.minimum(out, len(LETTERS) - 1)]
    out = np.where(letter, out, 32)
    keep = letter | np.concatenate(([True], letter[:-1]))
    return out[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


#: Whether a code point is a letter.
LETTERS = np.array([chr(i).isalpha() for i in range(0x32400)])


def automaton(codes: np.ndarray, classes: int) -> np.ndarray:
    """Transitions (state, class) -> state of the suffix automaton, -1 where a
    string doesn't occur (Blumer et al. 1985)."""
    return split_automaton(codes, classes)[0]


def split_automaton(codes: np.ndarray, classes: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The transitions of codes under ``classes`` as a table, and those of the others
    as (sorted keys state << 32 | code, states); at most three for each character."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        now, p = len(follow), last
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = clone
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
        last = now
    table, rare = np.full((len(follow), classes), -1, np.int32), {}
    for state, edges in enumerate(follow):
        for c, to in edges.items():
            if c < classes:
                table[state, c] = to
            else:
                rare[state << 32 | c] = to
    keys = sorted(rare)
    return table, (np.array(keys, np.int64), np.array([rare[k] for k in keys], np.int32))


@dataclass
class LanguageModel:
    """Sample text of each language; tables are made where they are used."""

    samples: dict[str, str]

    def __post_init__(self):
        names, counts = np.unique(np.concatenate([np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in self.samples.values()] or [np.zeros(0, np.uint32)]), return_counts=True)
        order = np.argsort(-counts, kind="stable")
        numbers = np.empty(len(names), np.int32)
        numbers[order] = np.arange(len(names)) + (np.arange(len(names)) >= CLASSES - 1)
        self.alphabet, self.numbers = names, numbers

    def codes(self, text: str) -> np.ndarray:
        """Codes of a text's characters; CLASSES - 1 is any that no sample has."""
        points = np.frombuffer(plain(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), max(len(self.alphabet) - 1, 0))
        return np.where(self.alphabet[at] == points, self.numbers[at], CLASSES - 1).astype(np.int32) if len(self.alphabet) else np.full(len(points), CLASSES - 1, np.int32)

    def tables(self) -> list[tuple[str, np.ndarray, tuple[np.ndarray, np.ndarray], float]]:
        """(language, transitions, sparse ones, bits of a position) of each language with text."""
        out = []
        for lang, sample in sorted(self.samples.items()):
            codes = self.codes(sample)
            table, rare = split_automaton(codes, CLASSES)
            out.append((lang, table.ravel(), rare, math.log2(len(codes) + 2)))
        return out


def reach(table: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None, state: np.ndarray, c: np.ndarray) -> np.ndarray:
    """States after characters ``c``, -1 where there is none."""
    to = table[state * CLASSES + np.minimum(c, CLASSES - 1)]
    if rare is not None and len(rare[0]) and len(odd := np.flatnonzero(c >= CLASSES)):
        key = state[odd].astype(np.int64) << 32 | c[odd]
        at = np.minimum(np.searchsorted(rare[0], key), len(rare[0]) - 1)
        to[odd] = np.where(rare[0][at] == key, rare[1][at], -1)
    return to


def side_by_side(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parse each stretch codes[start:end] as if a phrase began at its start; all
    stretches advance together, longest first, so that those that end drop off the tail.

    Returns, for each position, how many phrases its stretch has before the one that
    begins there (-1 where none does); for each stretch, its complete phrases and the
    state in which it ends (0 if no phrase is open)."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order], (ends - starts)[order]
    count, state = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
    number = np.full(len(codes), -1, np.int32)
    number[starts] = 0
    alive = len(order)
    for step in range(int(left[0]) if len(left) else 0):
        while alive and left[alive - 1] <= step:
            alive -= 1
        here = at[:alive] + step
        c = codes[here]
        to = reach(table, rare, state[:alive], c)
        stuck = np.flatnonzero(to < 0)
        if len(stuck):
            done = count[stuck] + (state[stuck] > 0)
            number[here[stuck]] = done
            anew = reach(table, rare, np.zeros(len(stuck), np.int32), c[stuck])
            count[stuck] = done + (anew < 0)  # a character that the sample lacks is a phrase of its own
            alone = stuck[(anew < 0) & (left[stuck] > step + 1)]
            number[here[alone] + 1] = count[alone]
            to[stuck] = np.maximum(anew, 0)
        state[:alive] = to
    complete, last = np.empty_like(count), np.empty_like(state)
    complete[order], last[order] = count, state
    return number, complete, last


def phrases(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None = None, stretch: int = STRETCH) -> np.ndarray:
    """Longest-match phrases of each text codes[start:end], parsed from left to right.

    Stretches of a text are parsed side by side. Then the parse is carried over their
    borders: the phrase open at the end of one goes on into the next, and phrases
    follow it there until one begins where the stretch's own parse began one; from
    there on the two are the same. So matches cross borders, and the work stays
    proportional to the text.
    """
    pieces = -(-(ends - starts) // stretch)
    owner = np.repeat(np.arange(len(starts)), pieces)
    a = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
    b = np.minimum(a + stretch, ends[owner])
    number, complete, last = side_by_side(table, codes, a, b, rare)
    edges, points, begun = memoryview(table), memoryview(np.ascontiguousarray(codes)), memoryview(number)
    rest = dict(zip(rare[0].tolist(), rare[1].tolist(), strict=True)) if rare is not None else {}

    def end_of(state: int, at: int, end: int) -> int:
        """Where the phrase ends that has come to ``state`` before position ``at``."""
        first = state == 0
        while at < end:
            c = points[at]
            state = edges[state * CLASSES + c] if c < CLASSES else rest.get(state << 32 | c, -1)
            if state < 0:
                return at + 1 if first else at
            first = False
            at += 1
        return at

    out = np.zeros(len(starts), np.int64)
    text, at = -1, 0
    for i, border, complete_k, state, text_end in zip(owner.tolist(), b.tolist(), complete.tolist(), last.tolist(), ends[owner].tolist(), strict=True):
        if i != text:
            text, at, total = i, int(starts[i]), 0
        while at < border and begun[at] < 0:
            at = end_of(0, at, text_end)
            total += 1
        if at < border:
            total += complete_k - begun[at]
            at = border
            if state:
                total += 1
                at = end_of(state, border, text_end)
        out[i] = total
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_chars: int = SAMPLE_CHARS, all_chars: int = ALL_CHARS) -> LanguageModel:
    """Learn from a sample bounded at ``sample_chars`` for each language, and at
    ``all_chars`` for all of them.

    Rows are taken in the order of a hash of key and text, so many of each language
    as about fill its sample twice; a language of little text is taken whole. A text
    longer than the sample gives a piece from a place that the hash chooses. Null
    languages and texts are left out.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    totals = {r[0]: r[1:] for r in rows.groupBy(lang).agg(F.count("*"), F.sum(F.length(text))).collect()}
    each = max(256, min(sample_chars, all_chars // max(len(totals), 1)))
    if not totals:
        return LanguageModel({})
    spot = F.pmod(F.xxhash64(key, text), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = 1 + F.pmod(F.xxhash64(text, key), F.greatest(F.length(text) - each, F.lit(0)) + 1)
    share = {k: min(1.0, 2 * max(each / chars, 8 / n)) for k, (n, chars) in totals.items()}
    wanted = F.lit(False)
    for k, p in share.items():
        wanted = wanted | ((F.col(lang) == k) & (spot < p))
    samples: dict[str, list[str]] = {k: [] for k in totals}
    for name, piece in rows.filter(wanted).select(lang, F.substring(F.col(text), place.cast("int"), F.lit(each)).alias("piece"), spot.alias("spot")).orderBy("spot", lang, "piece").drop("spot").toLocalIterator():
        if sum(map(len, samples[name])) < each:
            samples[name].append(plain(piece))
    return LanguageModel({k: " ".join(v)[:each] for k, v in samples.items()})


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Append lang_pred and score (0 to 1) to ``df``.

    The whole text counts. ``und`` and 0 for a null text, one without a letter, or a
    model without languages. The score is the winner's share of the inverse
    entropies; ties go to the language that sorts first. Columns of the same names
    are replaced; rows neither move nor merge.
    """

    def setup():
        tables = model.tables()

        def fn(texts: list) -> list:
            coded = [model.codes(t) if t else np.zeros(0, np.int32) for t in texts]
            known = [bool(len(c)) and (len(c) > 1 or plain(t) != " ") for c, t in zip(coded, texts, strict=True)]
            if not tables or not any(known):
                return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
            codes, lengths = np.concatenate(coded), np.array([len(c) for c in coded])
            ends = np.cumsum(lengths)
            starts = np.where(known, ends - lengths, ends)
            bits = np.array([b * phrases(table, codes, starts, ends, rare) for _, table, rare, b in tables]) / np.maximum(lengths, 1)
            best = np.argmin(bits, axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (1 / bits[best, np.arange(len(texts))]) / (1 / bits).sum(axis=0)
            return [
                [tables[b][0] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)],
                pa.array(np.where(known, score, 0.0)),
            ]

        return fn

    return map_texts(df, text, PREDICTED, setup, keep_text, limit=4 << 20)  # many stretches side by side
