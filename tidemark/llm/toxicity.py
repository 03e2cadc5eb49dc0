"""Toxicity grades by cumulative-link ordinal regression on word features.

A text's features are its words and their beginnings of ``STEMS`` bytes, which
inflected forms share, each as 1 + log(count).

One set of weights serves all thresholds: the odds that a text's grade passes
threshold k are exp(weights . words - threshold k), thresholds ascending
(McCullagh 1980). The sum of these probabilities is the expected grade.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_texts
from tidemark.llm.decontaminate import words_of
from tidemark.llm.quality import bounded_sample

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Lengths of the beginnings, in bytes.
STEMS = (4, 5, 6)
#: Texts of the sample that must hold a feature, and standard errors by which its
#: log-odds must differ from none. Every feature that passes both bears a weight.
LEAST_TEXTS, LEAST_Z = 3, 2.0
#: Grades of toxic texts: 1 mild to 3 severe.
GRADES = 3

SCORED = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("grade", T.IntegerType())])


def features_of(text: str | None) -> Counter:
    """Counts of words, and of beginnings, marked by a leading ``^``."""
    words = Counter(words_of(text))
    out = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                out[b"^" + w[:k]] += n
    return out


@dataclass
class OrdinalModel:
    """weights by feature, ascending thresholds."""

    weights: dict[bytes, float]
    thresholds: np.ndarray

    def passing(self, texts: list) -> np.ndarray:
        """P(grade > k) of each text, one column for each threshold."""
        known = self.weights.keys()
        sums = np.zeros(len(texts))
        for i, t in enumerate(texts):
            counts = features_of(t)
            sums[i] = sum(self.weights[w] * (1 + math.log(counts[w])) for w in sorted(known & counts.keys()))
        return 1 / (1 + np.exp(-np.clip(sums[:, None] - self.thresholds[None, :], -30, 30)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, steps: int = 400, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) that maximise the likelihood of ``grades`` (0 to
    ``n_grades``) given the sparse values at (row, column), by Adam on all rows.

    Thresholds ascend as the first plus sums of exponentials.
    """
    n = len(grades)
    share = (np.array([(grades > k).sum() for k in range(n_grades)]) + 0.5) / (n + 1)
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    z = np.concatenate((np.zeros(n_features), start[:1], gaps))
    m, v = np.zeros_like(z), np.zeros_like(z)
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
    at = np.arange(n)
    for t in range(1, steps + 1):
        w, cuts = z[:n_features], z[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(z[n_features + 1 :]))))
        eta = np.bincount(rows, w[cols] * values, n) if len(rows) else np.zeros(n)
        # P(grade = y) = P(> y - 1) - P(> y), with 1 before the first threshold and 0 after the last
        p = np.hstack((np.ones((n, 1)), sigmoid(eta[:, None] - cuts[None, :]), np.zeros((n, 1))))
        hi, lo = p[at, grades], p[at, grades + 1]
        each = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / each, lo * (1 - lo) / each
        d_eta = -(d_hi - d_lo) / n
        d_cut = np.zeros(n_grades + 2)
        np.add.at(d_cut, grades, d_hi / n)
        np.add.at(d_cut, grades + 1, -d_lo / n)
        d_cut = d_cut[1:-1]
        grad = np.empty_like(z)
        grad[:n_features] = (np.bincount(cols, d_eta[rows] * values, n_features) if len(rows) else 0) + decay * w
        grad[n_features] = d_cut.sum()
        grad[n_features + 1 :] = np.exp(z[n_features + 1 :]) * np.cumsum(d_cut[::-1])[::-1][1:]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        z = z - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return z[:n_features], z[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(z[n_features + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS, grades: int = GRADES) -> OrdinalModel:
    """Fit on at most ``rows`` labelled keys.

    Features are all whose document frequencies in toxic and other texts differ by
    more than chance (``LEAST_TEXTS``, ``LEAST_Z``); the sample alone bounds them. A label of 0 or 1 becomes a grade: 0, or, among toxic texts, by how much
    of the text is marked (features ten times as frequent in toxic texts), cut at
    equal numbers of texts into 1 to ``grades``. Without both labels nothing has weight.
    """
    sample = bounded_sample(docs.select(key, text), labels, label, key, rows).select(F.col("__label").alias("y"), F.xxhash64(key, text).alias("spot"), text)
    vocabulary = T.StructType([T.StructField("words", T.ArrayType(T.BinaryType()))])
    distinct = map_texts(sample, text, vocabulary, lambda: lambda texts: [[sorted(features_of(t)) for t in texts]], keep_text=False)
    totals = {r.y > 0: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = float(totals.get(True, 0)), float(totals.get(False, 0))
    if not bad or not good:
        return OrdinalModel({}, np.full(grades, np.inf if not bad else -np.inf))
    in_bad, in_good = F.sum((F.col("y") > 0).cast("double")), F.sum((F.col("y") <= 0).cast("double"))
    counted = distinct.select("y", F.explode("words").alias("word")).groupBy("word").agg(in_bad.alias("b"), in_good.alias("g")).filter(F.col("b") + F.col("g") >= LEAST_TEXTS)
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
    spread = F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("g") + 0.5))
    top = counted.select("word", odds.alias("odds"), F.abs(odds / spread).alias("z")).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").collect()
    index = {bytes(r.word): i for i, r in enumerate(top)}
    marked = np.array([r.odds > np.log(10) and r.z > 2 for r in top], bool)
    pairs = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("count", T.ArrayType(T.IntegerType()))])

    def setup():
        def fn(texts: list) -> list:
            counts = [features_of(t) for t in texts]
            found = [sorted((index[w], c[w]) for w in index.keys() & c.keys()) for c in counts]
            return [[[k for k, _ in f] for f in found], [[n for _, n in f] for f in found]]

        return fn

    got = map_texts(sample, text, pairs, setup, keep_text=False).toArrow()
    got = got.take(np.lexsort((got["y"].to_numpy(), got["spot"].to_numpy())))  # the same sums whatever came first
    y = got["y"].to_numpy()
    sizes = pa.compute.list_value_length(got["at"]).to_numpy()
    cols = pa.compute.list_flatten(got["at"]).to_numpy()
    counts = pa.compute.list_flatten(got["count"]).to_numpy()
    line = np.repeat(np.arange(len(y)), sizes)
    amount = np.bincount(line, (1 + np.log(counts)) * marked[cols], len(y)) if len(line) else np.zeros(len(y))
    cuts = np.quantile(amount[y > 0], np.linspace(0, 1, grades + 1)[1:-1])
    grade = np.where(y > 0, 1 + np.searchsorted(cuts, amount, side="left"), 0)
    weights, thresholds = fit_ordinal(line, cols, (1 + np.log(counts)), grade, len(top), grades)
    return OrdinalModel({w: float(weights[i]) for w, i in index.items()}, thresholds)


def score(df: DataFrame, model: OrdinalModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Append severity (expected grade), score (probability of any toxicity) and
    grade (the thresholds that are likelier passed than not).

    The whole text counts; null and empty texts have no words, so the thresholds
    alone decide. Columns of the same names are replaced; rows neither move nor merge.
    """

    def setup():
        def fn(texts: list) -> list:
            p = model.passing(texts)
            return [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))]

        return fn

    return map_texts(df, text, SCORED, setup, keep_text)
