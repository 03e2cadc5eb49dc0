import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm import queries


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    alone = Q.fit_tables(x, y, pairs=0)
    both = Q.fit_tables(x, y, pairs=3)
    right = lambda m: ((m.score(x) >= 0.5) == y).mean()
    assert right(alone) < 0.65 and right(both) > 0.9 and (1, 0) in both.pairs


def test_score_is_a_sum_of_looked_up_bins():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    m = Q.fit_tables(x, (x[:, 0] > 0.3).astype(float), rounds=20, pair_rounds=5, pairs=2)
    for row, got in zip(x[:20], m.score(x[:20]), strict=True):
        total = m.base + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(m.edges, m.tables, row, strict=True))
        bins = [np.searchsorted(e, v, side="right") for e, v in zip(m.coarse, row, strict=True)]
        total += sum(t[bins[i], bins[j]] for (i, j), t in m.pairs.items())
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12


def test_one_label_or_none():
    x = np.zeros((5, 2))
    assert (Q.fit_tables(x, np.ones(5)).score(x) > 0.5).all() and (Q.fit_tables(x[:0], np.zeros(0)).score(x) == 0.5).all()


def test_frame_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "a b", 9.0), (3, "a b", 9.0), (None, "x " * 40000, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (None, 1), (2, None)], "doc_id long, quality int")
    rows = Q.score(docs, Q.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score and rows[2].score == rows[3].score
    assert Q.score(docs.limit(0), Q.fit(docs, labels.limit(0))).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    for label in (0, 1):
        some = [r for r in rows if r.quality == label]
        assert sum(r.predicted == label for r in some) >= 0.95 * len(some) > 50


def test_held_out_labels_teach_nothing(spark):
    sf = "/root/testdata/sf0.001"
    whole = queries.quality_model(spark, sf)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from tidemark.llm.common import held_out

    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.fit(docs, flipped.filter(~held_out()))
    assert whole.base == again.base and all((a == b).all() for a, b in zip(whole.tables, again.tables, strict=True))
