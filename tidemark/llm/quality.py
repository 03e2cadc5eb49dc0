"""Quality classifier: a generalised additive model with pairwise interactions.

The log-odds of a good text are a sum of one lookup table for each feature and a
few for pairs of features. The tables are learned by cyclic boosting: again and
again each feature in turn gets a shallow tree over its bins, fitted to what the
sum still misses, and a small step of it is added to the feature's table (Lou et
al. 2013). Scoring looks up and adds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_texts

FEATURES = (
    "log_bytes", "word_length", "upper", "digits", "symbols", "marks", "bars", "blanks", "beyond_ascii",
    "distinct_words", "repeated_words", "symbol_words", "capital_words", "line_length", "distinct_lines", "sentence_ends",
)
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_BLANK = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_MARK = np.isin(_BYTE, list(b".,;:!?'\"-()"))
_SYMBOL = (_BYTE < 128) & (_BYTE > 32) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_MARK
_WORDY = _UPPER | _LOWER | (_BYTE >= 128)


def features(text: str | None) -> list[float]:
    """Figures of the whole text, in the order of ``FEATURES``; zeros for no text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, letters = len(raw), max(1, int(counts[_WORDY].sum()))
    words = raw.split()
    m = max(1, len(words))
    lines = raw.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    odd = sum(1 for w in words if w[-1] in b"!*#$%&|" or w[0] in b"*#$%&|")
    return [
        float(np.log1p(n)), letters / m, counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / n, counts[_SYMBOL].sum() / n,
        counts[_MARK].sum() / n, counts[124] / m, counts[_BLANK].sum() / n, counts[128:].sum() / n,
        len(set(words)) / m, same / m, odd / m, sum(1 for w in words if w.isupper()) / m, float(np.log1p(n / len(lines))),
        len(set(lines)) / len(lines), (counts[33] + counts[46] + counts[63]) / m,
    ]


def shallow_tree(g: np.ndarray, h: np.ndarray, smooth: float, depth: int = 2) -> np.ndarray:
    """Newton steps of the leaves of a tree over ordered bins, one value for each bin."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + smooth) + 1e-9:
            return np.concatenate((shallow_tree(g[:cut], h[:cut], smooth, depth - 1), shallow_tree(g[cut:], h[cut:], smooth, depth - 1)))
    return np.full(len(g), g.sum() / (h.sum() + smooth))


def quarter_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """A tree that cuts a grid of bins once along one axis and each half along the
    other; (a value for each cell, gain)."""
    best = None
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        ga, ha = np.cumsum(a, axis=0), np.cumsum(b, axis=0)
        for cut in range(1, len(a)):
            halves, gain = [], 0.0
            for gg, hh in ((ga[cut - 1], ha[cut - 1]), (ga[-1] - ga[cut - 1], ha[-1] - ha[cut - 1])):
                leaf = shallow_tree(gg, hh, smooth, 1)
                halves.append(leaf)
                gain += float((leaf * gg).sum())
            if best is None or gain > best[1]:
                cells = np.vstack([np.tile(halves[0], (cut, 1)), np.tile(halves[1], (len(a) - cut, 1))])
                best = (cells.T if turn else cells), gain
    return best if best is not None else (np.full(g.shape, g.sum() / (h.sum() + smooth)), 0.0)


@dataclass
class AdditiveModel:
    """Bin edges and tables; ``pairs`` maps two features to a table over coarse bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    @staticmethod
    def bins(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self.bins(self.edges, x), self.bins(self.coarse, x)
        total = np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            total += t[fine[:, i]]
        for (i, j), t in self.pairs.items():
            total += t[rough[:, i], rough[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_tables(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.1, fine: int = 32, rough: int = 8, smooth: float = 1.0) -> AdditiveModel:
    """Learn from features and labels 0 or 1. Without both labels, a constant: 0.5
    for none, else near the only one."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, fine + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, rough + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, {})
    if len(np.unique(y)) < 2:
        return model
    b, total = model.bins(edges, x), np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(b[:, i], g, len(table)), np.bincount(b[:, i], h, len(table)), smooth)
            table += step
            total += step[b[:, i]]
    c = model.bins(coarse, x)

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = c[:, i] * shape[1] + c[:, j]
        g, h = slopes()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell

    gains = {(i, j): quarter_tree(*grid(i, j)[:2], smooth)[1] for i in range(x.shape[1]) for j in range(i)}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    for i, j in chosen:
        model.pairs[i, j] = np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h, cell = grid(i, j)
            step = rate * quarter_tree(g, h, smooth)[0]
            model.pairs[i, j] += step
            total += step.ravel()[cell]
    return model


def with_features(df: DataFrame, text: str = "text", name: str = "features", keep_text: bool = False) -> DataFrame:
    added = T.StructType([T.StructField(name, T.ArrayType(T.DoubleType(), False))])
    return map_texts(df, text, added, lambda: lambda texts: [[features(t) for t in texts]], keep_text)


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """Documents with their label, of the ``rows`` labelled keys at most that come
    first by hash. Null keys and labels are left out; of a key's labels the largest
    counts. The labels' side is bounded, so it is broadcast and no text moves."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("__label"))
    known = known.orderBy(F.xxhash64(key), key).limit(rows).withColumnRenamed(key, "__key")
    return docs.join(F.broadcast(known), docs[key] == F.col("__key")).drop("__key")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most ``rows`` labelled keys; only their features come to the driver."""
    sample = bounded_sample(docs.select(key, text), labels, label, key, rows).select(text, "__label", F.xxhash64(key, text).alias("__spot"))
    got = with_features(sample, text).select("__label", "__spot", "features").toArrow()
    x = np.array(got["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((got["__label"].to_numpy(), got["__spot"].to_numpy())) if len(x) else slice(0)
    return fit_tables(x[order], (got["__label"].to_numpy() > 0).astype(float)[order])


def score(df: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    """Append the score, 0 to 1, higher for a likelier good text.

    Every text has one, null and empty ones that of a text of no bytes; the whole
    text counts. A column of the same name is replaced; rows neither move nor merge.
    """
    added = T.StructType([T.StructField(name, T.DoubleType())])
    setup = lambda: lambda texts: [pa.array(model.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))]
    return map_texts(df, text, added, setup, keep_text)
