import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.operators import paths

SF = "/root/testdata/sf0.1"


def brute(vectors, asked, k):
    """Rows (query, vector, rank) by comparing all pairs."""
    out = []
    for i in asked:
        q = np.array(vectors[i], float)
        near = sorted((-float(q @ np.array(v, float)) / np.sqrt(float(q @ q) * float(np.dot(v, v))), j) for j, v in vectors.items() if j != i)
        out += [(i, j, r) for r, (_, j) in enumerate(near[:k], 1)]
    return sorted(out)


def ranked(df):
    return sorted((r.query_id, r.vec_id, r.rank) for r in df.collect())


def test_every_id_divisible_by_20_is_asked(spark):
    rows = catalogue.QUERIES["q13_nearest_vectors_whole"](spark, SF).collect()
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 20 = 0").collect()]
    assert len(ids) == 100 and sorted((r.query_id, r.rank) for r in rows) == sorted((i, k) for i in ids for k in range(1, 6))


@pytest.mark.parametrize("blocks", [(8192, 2048), (40, 7)])
def test_blocks_against_all_pairs(spark, blocks):
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(-9, 10, 5).tolist() for i in range(300)} | {i: [3, 1, 4, 1, 5] for i in range(300, 380)}  # many equal ones
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    unfit = spark.createDataFrame([(400, None), (401, []), (402, [0.0] * 5), (403, [float("nan")] * 5), (404, [1.0, 2.0])], df.schema)
    got = ranked(paths.nearest_in_blocks(df.union(unfit), asked, 5, *blocks))
    assert {(q, r): vectors[v] for q, v, r in got if q >= 300} == {(q, r): [3, 1, 4, 1, 5] for q in range(300, 380, 4) for r in range(1, 6)}
    assert [x for x in got if x[0] >= 300] == [x for x in brute(vectors, range(300, 380, 4), 5)]
    scores = lambda rows: [round(float(np.dot(vectors[q], vectors[v])) / np.sqrt(float(np.dot(vectors[q], vectors[q])) * float(np.dot(vectors[v], vectors[v]))), 12) for q, v, _ in sorted(rows, key=lambda x: (x[0], x[2]))]
    assert scores(got) == scores(brute(vectors, range(0, 380, 4), 5))


def test_ranks_go_by_the_unrounded_cosine(spark):
    near = {0: [1.0, 0.0], 1: [1.0, 0.008], 2: [1.0, 0.004], 3: [1.0, 0.006]}  # all 1.0000 when rounded to 4 places
    df = spark.createDataFrame(list(near.items()), "vec_id long, embedding array<double>")
    asked = df.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert ranked(paths.nearest_in_blocks(df, asked, 2)) == [(0, 2, 1), (0, 3, 2)]


def test_whole_search_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(f"select query_id, vec_id, rank, cosine from ({catalogue.ORACLE['q13_nearest_vectors_whole']})").fetchall()
    assert sorted((r.query_id, r.vec_id, r.rank, r.cosine) for r in catalogue.QUERIES["q13_nearest_vectors_whole"](spark, SF).collect()) == sorted(want)


def test_smaller_search_against_sql_on_many_queries(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(f"select query_id, vec_id, rank, cosine from ({catalogue.ORACLE['q13_nearest_vectors']})").fetchall()
    got = [(r.query_id, r.vec_id, r.rank, r.cosine) for r in catalogue.QUERIES["q13_nearest_vectors"](spark, SF).collect()]
    assert len(got) == 500 and sorted(got) == sorted(want)


def test_path_encoder_against_eigenvectors(spark, tmp_path):
    urls = [f"https://{h}.org/{s}/{i % n}" for i in range(60) for h, s, n in (("a", "news", 3), ("b", "shop", 5), ("c.d", "wiki", 7))]
    pages = spark.createDataFrame([*enumerate(urls), (999, None), (998, "")], "page_id long, url string")
    model = paths.path_encoder(pages, 64, 3)
    w = np.array([r.weighed.toArray() for r in model.transform(paths._path_words(pages)).orderBy("page_id").select("weighed").collect()])
    axes = np.linalg.eigh(np.cov(w.T))[1][:, ::-1][:, :3]
    z = w @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    model.save(f"{tmp_path}/m")
    rows = paths.encoded_paths(paths.PipelineModel.load(f"{tmp_path}/m"), pages).orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows])
    assert len(rows) == 182 and np.allclose(x @ x.T, z @ z.T, atol=1e-4)  # directions may have either sign
    assert not np.any(x[-2:])
