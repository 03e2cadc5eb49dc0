import math
import random
from datetime import datetime, timedelta

import pytest

from tidemark.functions import table_functions


def rows():
    rng = random.Random(3)
    start = datetime(2024, 3, 30)
    out = [(i, rng.choice(["a", "b", None]), start + timedelta(minutes=rng.randrange(4000)), rng.choice([None, rng.random()]), "x") for i in range(200)]
    return [*out, (200, "a", None, 1.0, "x"), (201, "c", None, None, None), (202, "d", start, 0.5, "x"), (203, "d", start, 0.25, "x")]


def frame(spark, given):
    table_functions.register(spark)
    spark.createDataFrame(given, "id int, who string, at timestamp_ntz, worth double, Decayed string").createOrReplaceTempView("rows_given")


def test_running_decay_against_all_earlier_rows(spark):
    given = rows()
    frame(spark, given)
    got = spark.sql("select * from running_decay(TABLE(rows_given), key => 'who', at => 'at', value => 'worth', half_life => 6)")
    assert got.columns == ["id", "who", "at", "worth", "Decayed", "decayed_"]
    out = {r.id: r for r in got.collect()}
    assert len(out) == len(given) and all(tuple(out[g[0]])[:5] == g for g in given)
    order = lambda r: (r[2], r[3] is not None, r[3] or 0)
    for i, who, at, worth, _ in given:
        if at is None:
            assert out[i].decayed_ is None
        else:
            before = [r for r in given if r[1] == who and r[2] is not None and order(r) <= order((i, who, at, worth))]
            want = sum((r[3] or 0) * 2 ** (-(at - r[2]).total_seconds() / 3600 / 6) for r in before)
            assert math.isclose(out[i].decayed_, want, rel_tol=1e-9, abs_tol=1e-12)


def test_gap_sessions_against_a_loop(spark):
    given = rows()
    frame(spark, given)
    got = spark.sql("select id, session, place from gap_sessions(TABLE(rows_given), key => 'who', at => 'at', gap => 1800)").collect()
    out = {r.id: r for r in got}
    for who in {r[1] for r in given}:
        mine = sorted((r for r in given if r[1] == who and r[2] is not None), key=lambda r: r[2])
        session, last, want = 0, None, []
        for r in mine:
            session += last is None or (r[2] - last).total_seconds() > 1800
            last = r[2]
            want.append((r[2], session))
        assert sorted(want) == sorted((r[2], out[r[0]].session) for r in mine)
        for s in range(1, session + 1):
            places = sorted(out[r[0]].place for r in mine if out[r[0]].session == s)
            assert places == list(range(1, len(places) + 1))
    assert out[200].session is None and out[201].place is None


def test_empty_table_and_wrong_arguments(spark):
    frame(spark, [])
    assert spark.sql("select * from gap_sessions(TABLE(rows_given), key => 'who', at => 'at', gap => 60)").count() == 0
    for wrong in ("key => 'nobody', at => 'at', gap => 60", "key => 'who', at => 'at', gap => 0", "key => 'who', at => 'at', gap => null"):
        with pytest.raises(Exception, match="one of|over 0|constant"):
            spark.sql(f"select * from gap_sessions(TABLE(rows_given), {wrong})").count()
