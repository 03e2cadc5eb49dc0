import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, language, quality, queries, sentencepiece_codec, toxicity


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_fold(spark):
    rows = spark.range(50).select("id", common.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
    assert spark.sql("select cast(null as long) as doc_id").select(common.held_out()).first()[0] is False


def test_map_texts_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(i, "x" * (i * 1000 % 7001) if i % 5 else None, {"k": i}) for i in range(60)], "id long, text string, m map<string,int>").withColumn("n", F.lit("old"))
    added = T.StructType([T.StructField("n", T.LongType())])
    made = lambda: lambda texts: [[len(t or "") for t in texts]]
    out = common.map_texts(df, "text", added, made)
    assert out.columns == ["id", "text", "m", "n"]
    assert all(r.n == len(r.text or "") and r.m == {"k": r.id} for r in out.collect()) and out.count() == 60
    assert common.map_texts(df, "text", added, made, keep_text=False).columns == ["id", "m", "n"]


def test_names_that_differ_in_case_only_are_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(1, "plain words here", "a", "b", "c", "d"), (2, None, None, None, None, None)], "doc_id long, text string, SCORE string, IDS string, Grade string, Lang_Pred string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"), F.lit(1).alias("quality"))
    made = {
        "op1": (sentencepiece_codec.encode_frame(docs, queries.PIECE_MODEL), {"ids"}),
        "op2": (toxicity.score(docs, toxicity.fit(docs, labels)), {"score", "grade"}),
        "op4": (language.predict(docs, language.fit(docs.select("doc_id", "text", F.lit("en").alias("lang")))), {"score", "lang_pred"}),
        "op5": (quality.score(docs, quality.fit(docs, labels)), {"score"}),
    }
    for name, (out, names) in made.items():
        out.write.parquet(f"{tmp_path}/{name}")
        assert names <= set(out.columns) and len({c.lower() for c in out.columns}) == len(out.columns)


def test_cuts_are_shared_and_dropped(spark):
    cuts = common.Cuts(spark)
    one, two = cuts.cut(spark.range(3)), cuts.cut(spark.range(4))
    cuts.drop(one)
    assert two.count() == 4
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(f"{cuts.root}/1")


def test_workers_get_small_batches_unless_the_session_has_a_bound(spark):
    mine = spark.newSession()
    texts = mine.range(0, 20_000, 1, 1).select(F.expr("if(id = 77, repeat('y', 9000000), repeat('x', 2000))").alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    added = T.StructType([T.StructField("n", T.LongType())])
    assert common.map_texts(texts, "text", added, lambda: lambda t: [[len(x) for x in t]], keep_text=False).agg(F.sum("n")).first()[0] == 19_999 * 2000 + 9_000_000
    got = texts.mapInArrow(sizes, "rows long, bytes long").collect()
    # the row that goes past the bound is the last of its batch
    assert sum(r.rows for r in got) == 20_000 and sorted(r.bytes for r in got)[-2] <= 1.1 * common.BATCH_BYTES
    other = spark.newSession()
    other.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "12345678")
    common.small_batches(other.range(1))
    assert other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("12345678", "12345678b")
