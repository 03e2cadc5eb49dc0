import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm import toxicity as X
from tidemark.llm.common import held_out


def test_thresholds_share_weights_and_ascend():
    rng = np.random.default_rng(0)
    n, k = 4000, 6
    x = rng.poisson(1.0, (n, k)).astype(float)
    eta = x @ np.array([2.0, -1.0, 0.5, 0, 0, 0])
    grade = (eta[:, None] + rng.logistic(size=(n, 1)) > np.array([0.0, 1.5, 3.0])[None, :]).sum(axis=1)
    rows, cols = np.nonzero(x)
    w, cuts = X.fit_ordinal(rows, cols, x[rows, cols], grade, k, 3, steps=800, decay=0.0)
    assert np.allclose(w, [2.0, -1.0, 0.5, 0, 0, 0], atol=0.2) and np.allclose(cuts, [0, 1.5, 3], atol=0.3)
    assert (np.diff(cuts) > 0).all()


def small(spark, n=400):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain word "), F.when(F.col("id") % 4 == 0, F.repeat(F.lit("vileness "), (F.col("id") % 3 + 1).cast("int"))).otherwise(""), F.lit("here "), F.col("id") % 7).alias("text"))
    return docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))


def test_more_marked_words_are_severer(spark):
    model = X.fit(*small(spark))
    texts = [None, "", "plain word here", "vileness here", "VILENESS, vileness vileness", "vilenesses"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, grade string")
    rows = X.score(df, model).orderBy("doc_id").collect()
    assert len(rows) == 12
    s = [r.severity for r in rows[::2]]
    assert s[0] == s[1] and s[2] < 0.5 < s[3] < s[4] and s[5] > 0.5 and all(0 <= r.score <= 1 for r in rows)


def test_no_labels_no_weights(spark):
    docs, labels = small(spark, 20)
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert [r.grade for r in X.score(docs, X.fit(docs, some)).collect()] == [0] * 20
    assert X.score(docs.limit(0), X.fit(docs, labels)).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op2_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    bad = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.005 * len(rows)
    assert labels.filter(held_out()).count() == len(rows)
