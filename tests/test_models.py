from datetime import timedelta

import numpy as np
import pytest

from tidemark import catalogue
from tidemark.operators import relational, replay, supervised
from tidemark.plans import experiments
from tidemark.sources import runs
from tidemark.sources.tables import trace

SF = "/root/testdata/sf0.001"


def test_models_are_saved_and_give_the_same_again(spark, tmp_path):
    rows, out = trace(spark, SF), f"file://{tmp_path}/out"
    for action, name in (("actor-train", "q23_actor_fit"), ("rl-train-critic", "q30_critic_fit")):
        *_, path = experiments.run(spark, action, SF, out, "r1")
        assert path.endswith(f"models/{action}/run_id=r1")
        model = runs.load_model(out, action, "r1")
        again = supervised.act(model, supervised.training_rows(rows, 24, 6)) if action == "actor-train" else replay.criticised(model, rows)
        column = "probability" if action == "actor-train" else "critic"
        told = {r.event_id: r[column] for r in runs.load(spark, out, name).collect()}
        assert told and {r.event_id: r[column] for r in again.collect()} == told


def test_critic_is_least_squares_on_kinds_and_size(spark):
    rows = replay.fit_critic(trace(spark, SF)).select("kind", "size", "future", "critic").collect()
    kinds = sorted({r.kind for r in rows})
    x = np.array([[float(r.kind == k) for k in kinds] + [float(r["size"])] for r in rows])
    want = x @ np.linalg.lstsq(x, np.array([r.future for r in rows]), rcond=None)[0]
    assert np.allclose([r.critic for r in rows], want, atol=1e-4)


def test_actor_is_fitted_on_its_training_rows(spark):
    rows = supervised.fit_actor(supervised.training_rows(trace(spark, SF), 24, 6), ["n_recent", "reward"]).collect()
    train = [r for r in rows if r.split == "train"]
    x = np.array([[1.0, r.n_recent, r.reward] for r in train])
    y, w = np.array([r.label for r in train], float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(3), x.T @ (y - p))
    every = np.array([[1.0, r.n_recent, r.reward] for r in rows])
    assert np.allclose([r.probability for r in rows], 1 / (1 + np.exp(-every @ w)), atol=2e-3)


def test_policy_replay_against_a_loop(spark):
    from collections import OrderedDict

    rows = trace(spark, SF)
    want, caches = {}, {}
    for r in rows.orderBy("ts", "event_id").collect():
        cache = caches.setdefault(r.kind, OrderedDict())
        hit = r.folder in cache
        if hit:
            cache.move_to_end(r.folder)
        elif r.reward > 5.0:
            cache[r.folder] = None
            if len(cache) > 4:
                cache.popitem(last=False)
        want[r.event_id] = int(hit)
    assert {r.event_id: r.hit for r in replay.replayed(rows, 4, 5.0).collect()} == want


def test_approximate_distinct_is_near(spark):
    for r in relational.reach(trace(spark, SF)).collect():
        assert abs(r.approx_folders - r.n_folders) <= 1 + 0.06 * r.n_folders


def test_actor_is_judged_by_its_own_ranks(spark):
    rows = trace(spark, SF)
    model = supervised.actor_model(supervised.training_rows(rows, 24, 6), ["n_recent", "reward"])
    log = sorted(rows.collect(), key=lambda r: (r.ts, r.event_id))
    weights, x = model.stages[-1], {}
    for r in log:
        n = sum(s.folder == r.folder and 0 <= (r.ts - s.ts).total_seconds() <= 86_400 for s in log if s.ts <= r.ts)
        x[r.ts.date(), r.folder] = (n, r.reward)  # the day's last stays
    offered = {(r.day, r.folder) for r in supervised.candidates(rows).collect()}
    by_day, touched = {}, {}
    for (day, folder), (n, reward) in x.items():
        touched.setdefault(day, set()).add(folder)
        after = day + timedelta(days=1)
        if (after, folder) in offered:
            score = weights.coefficients[0] * n + weights.coefficients[1] * reward
            by_day.setdefault(after, []).append((-score, folder))
    for r in supervised.actor_quality(model, rows).collect():
        list_ = [f for _, f in sorted(by_day[r.day])][:20]
        ranks = [i + 1 for i, f in enumerate(list_) if f in touched[r.day]]
        assert r.n == len(touched[r.day]) and r.n_found == len(ranks) and abs(r.recall - len(ranks) / r.n) < 1e-9
        assert abs(r.reciprocal_rank - (1 / ranks[0] if ranks else 0)) < 1e-4 and abs(r.dcg - sum(1 / np.log2(k + 1) for k in ranks)) < 1e-3


def test_evaluation_loads_what_the_run_trained(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    for action in ("rl-evaluate", "actor-evaluate"):
        with pytest.raises(FileNotFoundError, match="run that first"):
            experiments.run(spark, action, SF, out, "r1")
    experiments.run(spark, "rl-train-critic", SF, out, "r1")
    experiments.run(spark, "rl-train-actor", SF, out, "r1")
    assert any("q45_trained_policy_value" in p for p in experiments.run(spark, "rl-evaluate", SF, out, "r1"))
    told = {r.estimator: r.value for r in runs.load(spark, out, "q45_trained_policy_value").collect()}
    want = {r.estimator: r.value for r in catalogue.q45(spark, SF).collect()}
    assert told.keys() == want.keys() and all(abs(told[k] - want[k]) < 1e-3 for k in told)
