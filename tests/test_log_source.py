import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.plans import experiments
from tidemark.sources import log_source, runs, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    log = tables.table(spark, SF, "events")
    for kind in tables.FORMATS:
        write = log.repartition(3).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind in ("csv", "json") else log.repartition(3).write
        write.format(kind).save(f"{root}/{kind}")
    return root


def rows(df):
    return sorted(map(str, df.select(*tables.LOG.names).collect()))


@pytest.mark.parametrize("kind", tables.FORMATS)
def test_formats_give_the_same_rows_in_pieces_of_any_length(spark, logs, kind):
    want = rows(tables.table(spark, SF, "events"))
    for size in (1 << 26, 5000, 97):
        log_source.register(spark)
        df = spark.read.format("accesslog").option("kind", kind).option("pieceBytes", size).load(f"{logs}/{kind}")
        assert rows(df) == want
        if kind in ("csv", "json") and size == 5000:
            assert df.rdd.getNumPartitions() >= 12


def test_filters_choose_pieces_and_rows(spark, tmp_path):
    log = tables.table(spark, SF, "events").coalesce(1).sortWithinPartitions("event_id")
    log.write.option("parquet.block.size", 4096).option("parquet.block.row.count.limit", 100).parquet(f"{tmp_path}/in")
    read = lambda push: tables.raw_log(spark, f"parquet:{tmp_path}/in", push_filters=push)
    df, plain = read(True), read(False)
    whole = df.rdd.getNumPartitions()
    for test in ("event_id = 77", "event_id >= 900 and event_id < 950", "event_id in (3, 400)", "event_type = 'purchase' and value > 100", "event_id <=> 5 or event_id = 6", "props is null", "ts > timestamp_ntz'2024-01-20'", "value is not null and length(props) > 8"):
        assert rows(read(True).filter(test)) == rows(log.filter(test)) == rows(plain.filter(test))
    assert plain.filter("event_id = 1").unionByName(plain.filter("event_id = 2")).count() == 2
    df = read(True)
    assert whole >= 10 and df.filter("event_id = 77").rdd.getNumPartitions() == 1
    plan = df.filter("event_id = 77 and length(props) > 1")._jdf.queryExecution().executedPlan().toString()
    assert "length(props" in plan and "event_id" not in plan.split("Filter")[1].split("\n")[0]


def test_lacking_columns_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('user_id,event_id,ts,extra\n7,1,2024-01-01 00:00:00,x\n,2,,"y,z"\n')
    (tmp_path / "in" / "_hidden.csv").write_text("event_id\n9\n")
    (tmp_path / "in" / "empty.csv").write_text("")
    (tmp_path / "in" / "head.csv").write_text("event_id,ts\n")
    got = tables.raw_log(spark, f"csv:{tmp_path}/in").orderBy("event_id").collect()
    assert [(r.event_id, r.user_id, str(r.ts), r.event_type, r.value) for r in got] == [(1, 7, "2024-01-01 00:00:00", None, None), (2, None, "None", None, None)]
    assert tables.raw_log(spark, SF) is None and tables.raw_log(spark, "/a:b/c") is None
    with pytest.raises(Exception, match="No such|FileNotFound|nothing"):
        tables.raw_log(spark, f"csv:{tmp_path}/nothing").count()


def test_a_stream_hands_out_each_file_once(spark, logs, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    parts = sorted(f for f in os.listdir(f"{logs}/json") if f.endswith(".json"))
    names = []
    for n, part in enumerate(parts):
        shutil.copy(f"{logs}/json/{part}", f"{tmp_path}/in/{n}.json")
        os.utime(f"{tmp_path}/in/{n}.json", (1_700_000_000 + n,) * 2)
        stream = tables.raw_log(spark, f"json:{tmp_path}/in", stream=True)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(once=True).start(f"{tmp_path}/out")
        query.awaitTermination(120)
        assert query.exception() is None
        names.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert names == sorted(set(names)) and rows(spark.read.parquet(f"{tmp_path}/out")) == rows(tables.table(spark, SF, "events"))


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_actions_run_from_raw_logs(spark, logs, tmp_path, kind):
    out = f"file://{tmp_path}/out"
    experiments.run(spark, "miss-attribution", f"{kind}:{logs}/{kind}", out, "raw")
    experiments.run(spark, "miss-attribution", SF, out, "table")
    for report in experiments.ACTIONS["miss-attribution"]:
        by_run = runs.load(spark, out, report)
        assert sorted(map(str, by_run.filter("run_id = 'raw'").drop("run_id").collect())) == sorted(map(str, by_run.filter("run_id = 'table'").drop("run_id").collect()))


def test_stream_of_raw_logs_in_order(spark, logs):
    got = catalogue.q58(spark, f"orc:{logs}/orc").agg(F.sum("n"), F.count("*")).first()
    assert got == catalogue.q58(spark, SF).agg(F.sum("n"), F.count("*")).first()
