from datetime import date, timedelta

import pytest

from tidemark.operators import demand
from tidemark.sources.tables import trace

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp, folder long, kind string"


def by_loop(days, size, chance):
    """(croston, sba, tsb) for each day after the first."""
    z, x, p, gone, out = float(days[0]), 1.0, 1.0, 1.0, []
    for y in days[1:]:
        out.append((z / x, (1 - size / 2) * z / x, p * z))
        if y:
            z, x, gone = z + size * (y - z), x + size * (gone - x), 1.0
            p += chance * (1 - p)
        else:
            gone, p = gone + 1, p - chance * p
    return out


def log(spark, days):
    start, rows = date(2024, 2, 27), []
    for folder, counts in days.items():
        for i, n in enumerate(counts):
            rows += [(len(rows) + k, f"{start + timedelta(days=i)} 12:00:0{k}", folder, "view") for k in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts string, folder long, kind string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "folder", "kind")


@pytest.mark.parametrize(("size", "chance"), [(0.2, 0.1), (1.0, 1.0), (0.05, 0.5)])
def test_fold_against_a_loop(spark, size, chance):
    days = {1: [2, 0, 0, 3, 1, 0, 0, 0, 0, 4], 2: [0, 0, 0, 1, 0, 0, 0, 0, 0, 0], 3: [1] * 10, 4: [0] * 9 + [5], None: [0, 2, 0, 0, 0, 2, 0, 0, 0, 0]}
    got = {}
    for r in demand.forecasts(log(spark, days), size, chance).orderBy("folder", "day").collect():
        got.setdefault(r.folder, []).append((r.n, r.croston, r.sba, r.tsb))
    for folder, counts in days.items():
        own = counts[next(i for i, n in enumerate(counts) if n) :]
        want = [(n, *f) for n, f in zip(own[1:], by_loop(own, size, chance), strict=True)]
        assert len(got.get(folder, [])) == len(want)
        assert all(a == pytest.approx(b) for a, b in zip(got.get(folder, []), want, strict=True))


def test_only_earlier_days_count(spark):
    """A rolling origin: what comes later changes no forecast."""
    a = {(r.folder, r.day): r for r in demand.forecasts(log(spark, {1: [2, 0, 1, 0, 0, 3]})).collect()}
    b = {(r.folder, r.day): r for r in demand.forecasts(log(spark, {1: [2, 0, 1, 0, 0, 9, 9, 9]})).collect()}
    assert all((b[k].croston, b[k].sba, b[k].tsb) == (r.croston, r.sba, r.tsb) for k, r in a.items())


def test_chance_falls_where_nothing_comes_and_errors_tell_it(spark):
    dead = {i: [3, 2, 3] + [0] * 40 for i in range(5)} | {9: [1] * 43}
    told = {r.method: r for r in demand.errors(demand.forecasts(log(spark, dead))).collect()}
    assert told["tsb"].mae < told["sba"].mae < told["croston"].mae and told["croston"].bias > 0
    assert {r.n for r in told.values()} == {6 * 39}


def test_smoothing_is_nearer_than_the_mean_of_q42(spark):
    told = {r.method: r for r in demand.errors(demand.forecasts(trace(spark, SF))).collect()}
    assert min(told[m].rmse for m in demand.METHODS) < told["mean3"].rmse < told["naive"].rmse


def test_no_accesses_no_forecasts(spark):
    none = trace(spark, SF).limit(0)
    assert demand.forecasts(none).count() == 0 and demand.errors(demand.forecasts(none)).count() == 0
