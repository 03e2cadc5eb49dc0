"""Experiments: what each action computes and writes.

``python -m tidemark ACTION INPUT OUTPUT RUN_ID`` runs one. Input is only read; each
run has its own directory, and one writer at a time holds the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import metadata

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.operators import decisions, paths, replay, supervised, vector_index
from tidemark.sources import runs
from tidemark.sources.tables import table, trace

#: Action -> reports (catalogue queries) that it writes.
ACTIONS: dict[str, tuple[str, ...]] = {
    "baseline": ("q02_lru_hits", "q03_lru_hits_sized", "q04_hit_curve", "q61_sampled_curve", "q05_hit_rate_by_day", "q05_hit_rate_by_folder"),
    "miss-attribution": ("q06_miss_class", "q07_attribution", "q08_worst_folders", "q09_reuse_gaps"),
    "sized-miss-attribution": ("q64_sized_miss_class",),
    "actor-build-vector-store": ("q10_path_tokens", "q11_path_rollup", "q12_hashed_vectors"),
    "path-company": ("q59_company_weights", "q60_company_vectors"),
    "actor-prepare-data": ("q14_trailing_count", "q15_since_last", "q16_daily_demand", "q17_last_kinds", "q18_decayed_score", "q19_next_access", "q20_split", "q21_negatives", "q22_training_rows"),
    "actor-train": (),
    "actor-evaluate": ("q24_candidates", "q25_recall", "q26_ranking_quality"),
    "rl-build-replay": ("q27_transitions", "q28_discounted_return", "q29_three_step_return"),
    "rl-train-critic": ("q46_td_matrix", "q47_td_critic"),
    "rl-train-actor": ("q48_fitted_q",),
    "rl-evaluate": ("q44_policy_value", "q49_greedy_policy_value"),
    "analysis": ("q35_json_props", "q36_cube", "q37_demand_ranks", "q38_folder_sets", "q39_as_of", "q40_within_an_hour", "q41_distinct_folders", "q54_month_of_sketches", "q55_sketch_bounds", "q62_running_decay", "q63_gap_sessions"),
    "demand-forecast": ("q42_demand_forecast", "q52_intermittent_forecast", "q53_forecast_error"),
    "ablation": ("q33_ablation", "q34_paired_capacities", "q56_ablation_intervals"),
}


def _critic(spark: SparkSession, sf_dir: str, out: str, run_id: str) -> PipelineModel:
    """The critic that this run saved, else one fitted now."""
    return runs.load_model(out, "rl-train-critic", run_id) if runs.has_model(spark, out, "rl-train-critic", run_id) else replay.critic_model(trace(spark, sf_dir))


#: Action -> how its model is fitted, from (spark, sf_dir, out, run_id).
FITTED = {
    "actor-build-vector-store": lambda spark, sf_dir, out, run_id: paths.path_encoder(table(spark, sf_dir, "pages")),
    "actor-train": lambda spark, sf_dir, out, run_id: supervised.actor_model(supervised.training_rows(trace(spark, sf_dir), 24, 6), ["n_recent", "reward"]),
    "rl-train-critic": lambda spark, sf_dir, out, run_id: replay.critic_model(trace(spark, sf_dir)),
    "rl-train-actor": lambda spark, sf_dir, out, run_id: replay.policy_model(replay.weighed(_critic(spark, sf_dir, out, run_id), trace(spark, sf_dir))),
}
#: Action -> (the action that saved the model, report, what the loaded model says).
SCORED = {
    "actor-build-vector-store": ("actor-build-vector-store", "q43_path_vectors", lambda spark, sf_dir, critic, model: paths.encoded_paths(model, table(spark, sf_dir, "pages"))),
    "actor-train": ("actor-train", "q23_actor_fit", lambda spark, sf_dir, critic, model: supervised.act(model, supervised.training_rows(trace(spark, sf_dir), 24, 6)).select("event_id", "label", "probability")),
    "actor-evaluate": ("actor-train", "q50_actor_recall", lambda spark, sf_dir, critic, model: supervised.actor_quality(model, trace(spark, sf_dir))),
    "rl-train-critic": ("rl-train-critic", "q30_critic_fit", lambda spark, sf_dir, critic, model: replay.criticised(model, trace(spark, sf_dir)).select("event_id", "future", "critic")),
    "rl-train-actor": ("rl-train-actor", "q31_policy_fit", lambda spark, sf_dir, critic, model: replay.acted(model, replay.weighed(critic(), trace(spark, sf_dir))).select("event_id", "weight", "policy")),
    "rl-evaluate": ("rl-train-actor", "q45_trained_policy_value", lambda spark, sf_dir, critic, model: decisions.trained_value(decisions.decisions(trace(spark, sf_dir)), model)),
}


def run(spark: SparkSession, action: str, sf_dir: str, out: str, run_id: str) -> list[str]:
    """Write the reports of an action; return their paths.

    An action that trains fits its model once and saves it; what the model says is told
    from the saved one. The evaluating actions load what the same run trained before and
    say so if it didn't; training the actor builds on the run's critic if there is one."""
    if action not in ACTIONS:
        raise ValueError(f"{action}: one of {', '.join(ACTIONS)}")
    with runs.writer(spark, out):
        if action in SCORED and action not in FITTED and not runs.has_model(spark, out, SCORED[action][0], run_id):
            raise FileNotFoundError(f"run {run_id} has no model of {SCORED[action][0]} under {out}; run that first")
        written = [runs.save(catalogue.QUERIES[name](spark, sf_dir), out, name, run_id) for name in ACTIONS[action]]
        saved = [runs.save_model(FITTED[action](spark, sf_dir, out, run_id), out, action, run_id)] if action in FITTED else []
        if action in SCORED:
            trained, report, says = SCORED[action]
            written.append(runs.save(says(spark, sf_dir, lambda: _critic(spark, sf_dir, out, run_id), runs.load_model(out, trained, run_id)), out, report, run_id))
        if action == "actor-build-vector-store":
            vectors = paths.encoded_paths(runs.load_model(out, action, run_id), table(spark, sf_dir, "pages"))
            saved += vector_index.save(vector_index.fit(vectors), vectors, out, run_id)
        return written + saved


def smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per table that the queries read: its name and whether it has rows."""
    names = ("events", "pages", "embeddings")
    return spark.createDataFrame([(n, not table(spark, sf_dir, n).isEmpty()) for n in names], "table string, has_rows boolean")


#: Packages that tasks import.
NEEDED = ("numpy", "pandas", "pyarrow", "xxhash")


def _version(package: str) -> str | None:
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


def dependencies(spark: SparkSession, packages: tuple[str, ...] = NEEDED) -> DataFrame:
    """One row per package: its version on the driver (null: missing), the versions that
    workers have, and whether all have the driver's. As many tasks ask as run at once,
    which reaches every executor only if each gets one."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"package": list(packages), "found": [_version(p) for p in packages]}, schema=pa.schema([("package", pa.string()), ("found", pa.string())]))

    tasks = spark.sparkContext.defaultParallelism
    found = spark.range(0, tasks, 1, tasks).mapInArrow(ask, "package string, found string")
    own = spark.createDataFrame([(p, _version(p)) for p in packages], "package string, driver string")
    seen = found.groupBy("package").agg(F.sort_array(F.collect_set("found")).alias("workers"), F.count_if(F.col("found").isNull()).alias("missing"))
    same = F.col("driver").isNotNull() & (F.col("missing") == 0) & (F.col("workers") == F.array("driver"))
    return own.join(seen, "package").select("package", "driver", "workers", same.alias("same"))
