import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as main
from tidemark.plans import experiments
from tidemark.sources import runs, tables
from tidemark.streaming import sessions

SF = "/root/testdata/sf0.001"


def test_each_run_has_its_own_directory(spark, tmp_path):
    out = str(tmp_path / "out")
    paths = experiments.run(spark, "miss-attribution", SF, out, "a")
    assert len(paths) == 4
    experiments.run(spark, "miss-attribution", SF, out, "b")
    with pytest.raises(Exception, match="(?i)exist"):
        experiments.run(spark, "miss-attribution", SF, out, "a")
    both = runs.load(spark, out, "q09_reuse_gaps").groupBy("run_id").agg(F.sum("n").alias("n")).collect()
    assert sorted((r.run_id, r.n) for r in both) == [("a", 1000), ("b", 1000)]
    with pytest.raises(ValueError):
        experiments.run(spark, "nothing", SF, out, "c")


def test_one_writer_at_a_time(spark, tmp_path):
    with runs.writer(spark, str(tmp_path)), pytest.raises(runs.Busy), runs.writer(spark, str(tmp_path)):
        pass
    with runs.writer(spark, str(tmp_path)):
        pass
    with pytest.raises(KeyError), runs.writer(spark, str(tmp_path)):
        raise KeyError
    with runs.writer(spark, str(tmp_path)):
        pass


def test_abandoned_lock_is_taken_over(spark, tmp_path):
    (tmp_path / "_writer").touch()
    with pytest.raises(runs.Busy), runs.writer(spark, str(tmp_path)):
        pass
    os.utime(tmp_path / "_writer", (0, 0))
    with runs.writer(spark, str(tmp_path), stale=2):
        time.sleep(3)  # the holder renews it meanwhile
        with pytest.raises(runs.Busy), runs.writer(spark, str(tmp_path), stale=2):
            pass
    assert not [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")]


def test_smoke_and_formats(spark, tmp_path):
    assert all(r.has_rows for r in experiments.smoke(spark, SF).collect())
    log = tables.table(spark, SF, "events")
    for kind in ("csv", "json", "orc"):
        (log.write.option("header", True) if kind == "csv" else log.write).format(kind).save(f"{tmp_path}/{kind}")
        assert tables.access_log(spark, f"{tmp_path}/{kind}", kind).count() == log.count()
    with pytest.raises(ValueError):
        tables.access_log(spark, "x", "xls")


def test_dependencies_of_driver_and_workers(spark):
    got = {r.package: r for r in experiments.dependencies(spark, (*experiments.NEEDED, "no-such-package")).collect()}
    assert all(got[p].same and got[p].workers == [got[p].driver] for p in experiments.NEEDED)
    assert not got["no-such-package"].same and got["no-such-package"].driver is None


def test_yaml_configuration(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "run.yaml"
    path.write_text("action: baseline\ninput: in\noutput: out\nrun_id: 7\nspark:\n  spark.sql.shuffle.partitions: 8\n")
    assert main.configured(str(path)) == (["baseline", "in", "out", "7"], {"spark.sql.shuffle.partitions": "8"})
    for wrong in ("action: x\nother: y\n", "- a list\n", ""):
        path.write_text(wrong)
        with pytest.raises(ValueError, match="unknown keys|no table"):
            main.configured(str(path))


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    tables.table(spark, SF, "events").repartition(3).write.parquet(f"{tmp_path}/in")
    rows = sessions.arrivals(spark, f"{tmp_path}/in", late="9999 hours")
    for name, made in (("s", sessions.sessions(rows)), ("d", sessions.demand(rows)), ("w", sessions.demand(rows, "2 hours", "1 hour"))):
        query = made.writeStream.format("memory").queryName(f"mem_{name}").outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination(120)
        static = tables.access_log(spark, f"{tmp_path}/in").withColumn("at", F.col("ts").cast("timestamp"))
        batch = {"s": sessions.sessions, "d": sessions.demand, "w": lambda r: sessions.demand(r, "2 hours", "1 hour")}[name](static)
        key = lambda r: (r.folder, r.start, r.n)
        assert sorted(map(key, spark.table(f"mem_{name}").collect())) == sorted(map(key, batch.collect()))


def test_finished_windows_are_appended(spark, tmp_path):
    tables.table(spark, SF, "events").write.parquet(f"{tmp_path}/in")
    sessions.to_folder(sessions.demand(sessions.arrivals(spark, f"{tmp_path}/in", "1 hour")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert 0 < spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] <= 1000


def test_configuration_file(tmp_path):
    from tidemark.__main__ import configured

    path = tmp_path / "run.toml"
    path.write_text('action = "baseline"\ninput = "in"\noutput = "out"\nrun_id = 7\n[spark]\n"spark.sql.shuffle.partitions" = 8\n')
    assert configured(str(path)) == (["baseline", "in", "out", "7"], {"spark.sql.shuffle.partitions": "8"})
    path.write_text('actoin = "baseline"')
    with pytest.raises(ValueError):
        configured(str(path))
