import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.operators import decisions as D
from tidemark.operators import replay
from tidemark.sources.tables import trace

SF = "/root/testdata/sf0.001"
COLUMNS = "folder long, day int, t int, state int, action int, reward double, next_state int, behaviour double, target double"


def world(seed=3, states=5, length=6):
    """A small known world: moves, rewards, and what two policies do in each state."""
    rng = np.random.default_rng(seed)
    go = rng.dirichlet(np.ones(states), (states, 2))
    return rng, go, rng.normal(5, 3, (states, 2)), rng.uniform(0.3, 0.7, states), rng.uniform(0.1, 0.9, states), length


def episodes(n, rate=0.9):
    rng, go, gain, logged, other, length = world()
    rows = []
    for e in range(n):
        s = int(rng.integers(len(logged)))
        long = int(rng.integers(1, length + 1))
        for t in range(long):
            a = int(rng.random() < logged[s])
            to = int(rng.choice(len(logged), p=go[s, a]))
            rows.append((e % 7, e // 7, t, s, a, float(gain[s, a] + rng.normal()), to if t + 1 < long else None, float(logged[s]), float(other[s])))
            s = to
    value = np.zeros(len(logged))
    worth = []
    for _ in range(length):  # with k steps to go
        each = gain + rate * go @ value
        value = other * each[:, 1] + (1 - other) * each[:, 0]
        worth.append(value.mean())
    return rows, float(np.mean(worth))


def by_loop(rows, q, rate=0.9):
    told, weights = {k: [] for k in ("logged", "per_decision", "doubly_robust")}, []
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: r[2])
        w, logged, weighed, robust, each = 1.0, 0.0, 0.0, None, []
        for k, (_, _, t, s, a, x, _, b, p) in enumerate(own):
            v = lambda st, pr: pr * q.get((st, 1), 0.0) + (1 - pr) * q.get((st, 0), 0.0)
            robust = v(s, p) if robust is None else robust
            w *= (p if a else 1 - p) / (b if a else 1 - b)
            each.append((w, x))
            after = v(own[k + 1][3], own[k + 1][8]) if k + 1 < len(own) else 0.0
            logged += rate**t * x
            weighed += rate**t * w * x
            robust += rate**t * w * (x + rate * after - q.get((s, a), 0.0))
        for k, x in zip(told, (logged, weighed, robust), strict=True):
            told[k].append(x)
        weights.append(each)
    out = {k: float(np.mean(x)) for k, x in told.items()}
    out["self_normalised"] = sum(rate**t * sum(e[t][0] * e[t][1] for e in weights if len(e) > t) / sum(e[min(t, len(e) - 1)][0] for e in weights) for t in range(max(map(len, weights))))
    return out


def test_estimates_find_the_true_value(spark):
    rows, true = episodes(6000)
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    policy = df.groupBy("state").agg(F.avg("target").alias("p"))
    q, _ = D.fitted_q(df, near=0.01, policy=policy)
    told = {r.estimator: r for r in D.evaluated(df, 0.9, q).collect()}
    for name in ("per_decision", "doubly_robust"):
        assert abs(told[name].value - true) < 4 * told[name].std_error
    assert abs(told["self_normalised"].value - true) < 4 * told["per_decision"].std_error
    assert told["doubly_robust"].std_error < 0.7 * told["per_decision"].std_error
    assert abs(told["logged"].value - true) > 4 * told["logged"].std_error  # the two policies do differ
    want = by_loop(rows, {(r.state, r.action): r.q for r in q.collect()})
    assert all(abs(told[k].value - want[k]) < 1e-6 for k in want)
    plain = {r.estimator: r.value for r in D.evaluated(df, 0.9).collect()}
    assert abs(plain["doubly_robust"] - plain["per_decision"]) < 1e-9


def test_impossible_actions_end_a_weight(spark):
    rows = [(1, 1, 0, 0, 1, 5.0, 1, 0.5, 0.0), (1, 1, 1, 1, 0, 7.0, None, 0.5, 0.5), (2, 1, 0, 0, 0, 1.0, None, 0.5, 0.0)]
    told = {r.estimator: r.value for r in D.evaluated(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert told == {"logged": (5 + 0.9 * 7 + 1) / 2, "per_decision": 1.0, "doubly_robust": 1.0, "self_normalised": 1.0}
    none = D.evaluated(spark.createDataFrame([], COLUMNS)).collect()
    assert {r.n_episodes for r in none} == {0} and {r.value for r in none} == {None}


def test_decisions_of_odd_rows(spark):
    rows = spark.sql("""select * from values (1L, timestamp_ntz'2024-01-01 10:00:00', 5L, 2L, 'purchase', 12.0D), (2L, timestamp_ntz'2024-01-01 11:00:00', 5L, 2L, null, null),
        (3L, timestamp_ntz'2024-01-02 00:00:00', 5L, 90L, 'view', 100.0D), (4L, timestamp_ntz'2024-01-01 10:00:00', null, 1L, 'purchase', 1.0D) as v(event_id, ts, folder, size, kind, reward)""")
    got = {r.event_id: (r.t, r.state, r.action, r.reward, r.next_state) for r in D.decisions(rows).collect()}
    assert got == {1: (0, 5, 1, 0.0, 4), 2: (1, 4, 0, 0.0, None), 3: (0, 27, 0, 0.0, None), 4: (0, 0, 1, 0.0, None)}
    assert D.decisions(rows.limit(0)).count() == 0


def system(rows, rate, fade, states=D.STATES):
    a, b, z, last = np.zeros((states, states)), np.zeros(states), None, None
    for r in rows:
        if (r.folder, r.day) != last:
            last, z = (r.folder, r.day), np.zeros(states)
        z = fade * z
        z[r.state] += 1
        a[:, r.state] += z
        if r.next_state is not None:
            a[:, r.next_state] -= rate * z
        b += z * r.reward
    return a, b


def held(df, rate, trace_):
    rows = df.orderBy("folder", "day", "t").collect()
    a, b = system(rows, rate, rate * trace_)
    got_a, got_b = np.zeros_like(a), np.zeros_like(b)
    for r in D.differences(df, rate, trace_).collect():
        if r.j < 0:
            got_b[r.i] = r.value
        else:
            got_a[r.i, r.j] = r.value
    assert np.allclose(a, got_a, rtol=1e-9, atol=1e-9) and np.allclose(b, got_b, rtol=1e-9, atol=1e-9)
    return a, b


def test_critic_solves_the_system_that_a_loop_adds_up(spark):
    df = D.decisions(trace(spark, SF))
    for rate, trace_ in ((0.9, 0.517), (0.9, 0.0), (0.5, 1.0)):
        a, b = held(df, rate, trace_)
        got = {r.state: r.value for r in D.td_critic(df, rate, trace_).collect()}
        met = sorted(got)
        assert np.allclose([got[i] for i in met], np.linalg.solve(a[np.ix_(met, met)], b[met]), atol=1e-6)


def test_traces_reach_over_blocks_of_long_episodes(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, D.STATES, 1501)
    s[:300] = np.where(rng.random(300) < 0.97, 2, 5)
    rows = [(e, 1, t, int(s[t]), 0, float(rng.normal()), int(s[t + 1]) if t < 1499 else None, 0.5, 0.5) for e in (1, 2) for t in range(1500)]
    df = spark.createDataFrame(rows, COLUMNS)
    for rate, trace_ in ((0.9, 0.5), (0.99, 0.9), (0.3, 0.3)):
        held(df, rate, trace_)


def test_fitted_values_equal_a_tabular_loop(spark):
    df = D.decisions(trace(spark, SF))
    rows = df.collect()
    q, done = D.fitted_q(df)
    want = {}
    for _ in range(300):
        best, sums = {}, {}
        for (s, _), x in want.items():
            best[s] = max(best.get(s, -np.inf), x)
        for r in rows:
            n, x = sums.get((r.state, r.action), (0, 0.0))
            sums[r.state, r.action] = n + 1, x + r.reward + 0.9 * (best.get(r.next_state, 0.0) if r.next_state is not None else 0.0)
        want = {k: x / n for k, (n, x) in sums.items()}
    got = {(r.state, r.action): r.q for r in q.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want) and 4 <= done < 200
    policy = {r.state: r.p for r in D.greedy(q, 0.2).collect()}
    for s in {s for s, _ in want}:
        one = want.get((s, 1), -np.inf) > want.get((s, 0), -np.inf)
        assert policy[s] == pytest.approx(0.9 if one else 0.1)
    assert D.fitted_q(df.limit(0))[0].count() == 0


def test_best_actions_are_no_worse_than_the_logged_ones(spark):
    told = {r.estimator: r for r in catalogue.q49(spark, SF).collect()}
    assert told["doubly_robust"].value >= told["logged"].value - 2 * told["doubly_robust"].std_error


def test_trained_policy_is_loaded_and_weighed_by_its_probabilities(spark):
    raw = trace(spark, SF)
    model = replay.policy_model(replay.weighed(replay.critic_model(raw), raw))
    df = D.decisions(raw)
    rows = D.probability(model, D.probability(D.propensity_model(df), df, "behaviour"), "target", seen="reward")
    assert rows.columns == [*df.columns, "behaviour", "target"]
    given = {r.event_id: r.p for r in model.transform(raw).select("event_id", F.col("__p").alias("p")).collect()}
    held_ = rows.collect()
    assert all(abs(r.target - given[r.event_id][1]) < 1e-12 for r in held_)
    q, _ = D.fitted_q(rows, near=D.ROUGH, policy=rows.groupBy("state").agg(F.avg("target").alias("p")))
    names = ("folder", "day", "t", "state", "action", "reward", "next_state", "behaviour", "target")
    want = by_loop([tuple(r[n] for n in names) for r in held_], {(r.state, r.action): r.q for r in q.collect()})
    told = {r.estimator: r.value for r in catalogue.q45(spark, SF).collect()}
    assert all(abs(told[k] - want[k]) < 2e-3 for k in want)
