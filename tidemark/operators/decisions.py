"""Decisions in access logs: what they were worth, and what others would have been.

A folder's accesses of one day are an episode. At each access the state is the folder's
size and the band of the access's reward, the action is whether the access is of one
kind, and the reward is that of the episode's next access (none after the last). All
operators take rows of that form, so any other binding to episodes does as well.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import Scratch

#: Bounds of the bands of a reward, and sizes of folders that have states of their own.
BANDS, SIZES = (10.0, 50.0, 100.0), 7
STATES = SIZES * (len(BANDS) + 1)
EPISODE = ("folder", "day")
#: Different moves that one task backs up.
TOGETHER = 500_000
#: How near the fixed point values come that only serve to lessen an estimate's variance.
ROUGH = 0.01


def state(size: Column, reward: Column) -> Column:
    """State from 0: larger sizes count as the largest, a null reward as none."""
    band = sum((F.coalesce(reward, F.lit(0.0)) >= b).cast("int") for b in BANDS)
    return ((F.least(size, F.lit(SIZES)) - 1) * (len(BANDS) + 1) + band).cast("int")


def decisions(trace: DataFrame, kind: str = "purchase") -> DataFrame:
    """One row per access: folder, day, t (from 0), state, action (0 or 1), reward,
    next_state (null after an episode's last), and what a model may look at: size and seen
    (the access's own reward). A null kind is action 0."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date")
    rows = trace.select("event_id", "folder", day.alias("day"), "ts", "size", F.col("reward").alias("seen"), state(F.col("size"), F.col("reward")).alias("state"), F.coalesce((F.col("kind") == kind).cast("int"), F.lit(0)).alias("action"))
    order = Window.partitionBy(*EPISODE).orderBy("ts", "event_id")
    after = F.lead("seen").over(order)
    return rows.select("event_id", *EPISODE, (F.row_number().over(order) - 1).alias("t"), "size", "seen", "state", "action", F.coalesce(after, F.lit(0.0)).alias("reward"), F.lead("state").over(order).alias("next_state"))


# Policies: the probability of action 1 in each row


def frequencies(rows: DataFrame) -> DataFrame:
    """Append behaviour: how often the logged decisions took action 1 in the row's state,
    each action counted once more than it was seen. A window over partial counts joined
    back; the states are few, the rows are not shuffled by state."""
    counts = rows.groupBy("state").agg(((F.sum("action") + 1) / (F.count("*") + 2.0)).alias("behaviour"))
    return rows.join(counts, "state")


def propensity_model(rows: DataFrame) -> PipelineModel:
    """The logged probability of action 1 by size and seen, as a logistic model."""
    fitted = LogisticRegression(featuresCol="__x", labelCol="action", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y")
    return Pipeline(stages=[VectorAssembler(inputCols=["size", "seen"], outputCol="__x"), fitted]).fit(rows)


def probability(model: PipelineModel, rows: DataFrame, name: str, seen: str = "seen") -> DataFrame:
    """Append a fitted model's probability of action 1. ``seen``: the model's name for that column."""
    out = model.transform(rows.withColumns({"__own": F.col(seen), seen: F.col("seen")}))
    return out.withColumns({name: vector_to_array("__p")[1], seen: F.col("__own")}).drop("__own", "__x", "__p", "__r", "__y")


# Backups


def moves(rows: DataFrame) -> DataFrame:
    """state, action, next_state, n and reward (a sum): all that a tabular backup needs, as
    many rows as there are different moves."""
    return rows.groupBy("state", "action", "next_state").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"))


def backup(made: DataFrame, q: DataFrame | None, rate: float, policy: DataFrame | None = None) -> DataFrame:
    """One Bellman backup of (state, action, q) over moves; no ``q`` is zero everywhere.

    The next state is worth its best action that was ever taken or, with a ``policy``
    (state, p: probability of action 1), what the policy makes of it, an action never
    taken there counting as worth nothing."""
    if q is None:
        worth = made.select(F.col("next_state"), F.lit(0.0).alias("v")).limit(0)
    elif policy is None:
        worth = q.groupBy(F.col("state").alias("next_state")).agg(F.max("q").alias("v"))
    else:
        weight = F.when(F.col("action") == 1, F.col("p")).otherwise(1 - F.col("p"))
        worth = q.join(policy, "state").groupBy(F.col("state").alias("next_state")).agg(F.sum(weight * F.col("q")).alias("v"))
    gain = F.col("reward") + rate * F.col("n") * F.coalesce("v", F.lit(0.0))
    return made.join(worth, "next_state", "left").groupBy("state", "action").agg((F.sum(gain) / F.sum("n")).alias("q"))


def fitted_q(rows: DataFrame, rate: float = 0.9, near: float = 1e-6, most: int = 400, at_once: int = 8, policy: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(state, action, q) at the fixed point of the backups, and how many it took.

    Stops once no value moved by more than ``near`` in the last backup, which with
    ``rate`` under 1 leaves it within near / (1 - rate) of the fixed point. Every
    ``at_once`` backups are written to the shared folder and read again, so no plan grows."""
    scratch = Scratch(rows.sparkSession)
    made = scratch.cut(moves(rows))
    made = made.coalesce(1 + made.count() // TOGETHER)  # in one partition nothing is shuffled
    q, done = None, 0
    while done < most:
        for _ in range(at_once):
            before, q = q, backup(made, q, rate, policy)
        done += at_once
        if before is None:
            q = scratch.cut(q)
            continue
        both = scratch.cut(q.join(before.withColumnRenamed("q", "was"), ["state", "action"], "left"))
        moved = both.agg(F.max(F.abs(F.col("q") - F.coalesce("was", F.lit(0.0))))).first()[0]
        q = both.select("state", "action", "q")
        if moved is None or moved <= near:
            break
    return q, done


def greedy(q: DataFrame, explore: float = 0.1) -> DataFrame:
    """(state, p): the probability of action 1 of a policy that takes the best action, the
    smaller one of equals, but with probability ``explore`` any."""
    best = q.groupBy("state").agg(F.max_by("action", F.struct("q", -F.col("action"))).alias("best"))
    return best.select("state", F.when(F.col("best") == 1, 1 - explore / 2).otherwise(explore / 2).alias("p"))


# Off-policy evaluation


def evaluated(rows: DataFrame, rate: float = 0.9, q: DataFrame | None = None) -> DataFrame:
    """What episodes would be worth under another policy: estimator, value, std_error,
    n_episodes and effective (episodes that would tell as much if they were the policy's own).

    ``rows``: decisions with behaviour and target, the probabilities of action 1 under the
    logged and the other policy. ``q``: (state, action, q), the other policy's values; any
    will do, good ones lessen the variance.

    * logged: mean discounted return as it was;
    * per_decision: each reward weighed by the product of the ratios of all decisions up to it;
    * self_normalised: for each step the weighed mean of its rewards, an episode that has
      ended weighing on with its last weight and no reward;
    * doubly_robust: the value of the first state by ``q``, and weighed what each step
      brought beyond ``q``'s expectation.

    One shuffle by episode; steps and episodes are aggregated before they meet. A logged
    action of probability 0 under the other policy ends an episode's weight for good."""
    took = lambda p: F.when(F.col("action") == 1, F.col(p)).otherwise(1 - F.col(p))
    rows = rows.withColumn("ratio", took("target") / took("behaviour"))
    if q is None:
        rows = rows.withColumns({"q": F.lit(0.0), "v": F.lit(0.0)})
    else:
        by_state = q.groupBy("state").agg(F.coalesce(F.max(F.when(F.col("action") == 0, F.col("q"))), F.lit(0.0)).alias("q0"), F.coalesce(F.max(F.when(F.col("action") == 1, F.col("q"))), F.lit(0.0)).alias("q1"))
        rows = rows.join(by_state, "state", "left").withColumns({"q0": F.coalesce("q0", F.lit(0.0)), "q1": F.coalesce("q1", F.lit(0.0))})
        rows = rows.withColumns({"q": F.when(F.col("action") == 1, F.col("q1")).otherwise(F.col("q0")), "v": F.col("target") * F.col("q1") + (1 - F.col("target")) * F.col("q0")})
    order = Window.partitionBy(*EPISODE).orderBy("t")
    rows = rows.withColumn("weight", F.product("ratio").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("v_next", F.coalesce(F.lead("v").over(order), F.lit(0.0)))
    fade = F.pow(F.lit(rate), F.col("t"))
    episodes = rows.groupBy(*EPISODE).agg(
        F.sum(fade * F.col("reward")).alias("logged"),
        F.sum(fade * F.col("weight") * F.col("reward")).alias("per_decision"),
        (F.max(F.when(F.col("t") == 0, F.col("v"))) + F.sum(fade * F.col("weight") * (F.col("reward") + rate * F.col("v_next") - F.col("q")))).alias("doubly_robust"),
        F.max_by("weight", "t").alias("last"),
        F.count("*").alias("length"),
    )
    plain = ("logged", "per_decision", "doubly_robust")
    sums = [f(c).alias(f"{c}_{k}") for c in plain for k, f in (("value", F.avg), ("dev", F.stddev_samp))]
    whole = episodes.agg(*sums, F.count("*").alias("n"), (F.sum("last") * F.sum("last") / F.sum(F.col("last") * F.col("last"))).alias("effective"))
    told = [F.struct(F.lit(c).alias("estimator"), F.col(f"{c}_value").alias("value"), (F.col(f"{c}_dev") / F.sqrt("n")).alias("std_error"), F.col("n").alias("n_episodes"), (F.col("n").cast("double") if c == "logged" else F.col("effective")).alias("effective")) for c in plain]
    three = whole.select(F.explode(F.array(*told)).alias("s"), "n", "effective")
    # the steps, as many as the longest episode has
    alive = rows.groupBy("t").agg(F.sum(F.col("weight") * F.col("reward")).alias("gain"), F.sum("weight").alias("weight"), F.lit(0.0).alias("over"))
    ended = episodes.groupBy(F.col("length").cast("int").alias("t")).agg(F.lit(0.0).alias("gain"), F.lit(0.0).alias("weight"), F.sum("last").alias("over"))
    steps = alive.unionByName(ended).groupBy("t").agg(*[F.sum(c).alias(c) for c in ("gain", "weight", "over")])
    steps = steps.withColumn("over", F.sum("over").over(Window.orderBy("t")))
    step = F.coalesce(F.try_divide("gain", F.col("weight") + F.col("over")), F.lit(0.0))
    normal = steps.agg(F.sum(fade * step).alias("value")).crossJoin(whole.select("n", "effective"))
    normal = normal.select(F.lit("self_normalised").alias("estimator"), "value", F.lit(None).cast("double").alias("std_error"), F.col("n").alias("n_episodes"), "effective")
    return three.select("s.*").unionByName(normal)


def trained_value(rows: DataFrame, policy: PipelineModel, rate: float = 0.9) -> DataFrame:
    """Evaluate a saved policy whose inputs are size and reward: the logged probabilities
    by a logistic model of the same inputs, the values by backups under the policy."""
    rows = Scratch(rows.sparkSession).cut(probability(policy, probability(propensity_model(rows), rows, "behaviour"), "target", seen="reward"))
    q, _ = fitted_q(rows, rate, ROUGH, policy=rows.groupBy("state").agg(F.avg("target").alias("p")))
    return evaluated(rows, rate, q)


def greedy_value(rows: DataFrame, rate: float = 0.9, explore: float = 0.1) -> DataFrame:
    """Evaluate the best actions by fitted values. ``rows``: decisions with behaviour."""
    policy = greedy(fitted_q(rows, rate)[0], explore)
    rows = rows.join(policy.withColumnRenamed("p", "target"), "state")
    return evaluated(rows, rate, fitted_q(rows, rate, ROUGH, policy=policy)[0])


# Temporal differences


def differences(rows: DataFrame, rate: float = 0.9, trace: float = 0.5) -> DataFrame:
    """The system of the least-squares temporal difference: (i, j, value), j = -1 for its
    right side; states that were never met have no entries.

    The row of state i sums, over all decisions, the trace of i times the state less
    ``rate`` times the next state, and times the reward; a trace fades by rate * trace a
    step and rises by one where its state is met.

    Traces are running sums of the inverse powers, in blocks of steps so short that no power
    leaves the doubles and so long that what lies two blocks back has faded below their
    precision. Every task adds up its own part of the matrix before anything is shuffled."""
    fade = rate * trace
    block = max(1, math.ceil(40 / -math.log(fade))) if fade > 0 else 1
    ids = range(STATES)
    rows = rows.withColumns({"b": F.floor(F.col("t") / block), "u": F.pmod(F.col("t"), F.lit(block))})
    rise = F.pow(F.lit(fade), -F.col("u").cast("double")) if fade > 0 else F.lit(1.0)
    own = [F.when(F.col("state") == i, rise).otherwise(0.0) for i in ids]
    inside = Window.partitionBy(*EPISODE, "b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    if fade > 0:
        before = rows.groupBy(*EPISODE, (F.col("b") + 1).alias("b")).agg(*[F.sum(c).alias(f"p{i}") for i, c in enumerate(own)])
        rows = rows.select("*", *[F.sum(c).over(inside).alias(f"z{i}") for i, c in enumerate(own)]).join(before, [*EPISODE, "b"], "left")
        z = [F.pow(F.lit(fade), F.col("u").cast("double")) * (F.col(f"z{i}") + fade**block * F.coalesce(f"p{i}", F.lit(0.0))) for i in ids]
    else:
        z = own
    rows = rows.select("state", "next_state", "reward", F.array(*z).alias("z"))
    ends = F.array(F.struct(F.col("state").alias("j"), F.lit(1.0).alias("c")), F.struct(F.col("next_state").alias("j"), F.lit(-rate).alias("c")), F.struct(F.lit(-1).alias("j"), F.col("reward").alias("c")))
    parts = rows.select("z", F.explode(ends).alias("e")).filter("e.j is not null").groupBy("e.j").agg(*[F.sum(F.col("z")[i] * F.col("e.c")).alias(f"s{i}") for i in ids])
    cells = parts.select("j", F.posexplode(F.array(*[f"s{i}" for i in ids])).alias("i", "value"))
    return cells.filter("value != 0").select("i", "j", "value")


def solved(cells: DataFrame) -> dict[int, float]:
    """State -> value of a system of differences, by least squares (it is as large as there
    are states, whatever the log)."""
    a, b, met = np.zeros((STATES, STATES)), np.zeros(STATES), set()
    for r in cells.collect():
        met.add(r.i)
        if r.j < 0:
            b[r.i] = r.value
        else:
            a[r.i, r.j] = r.value
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    return {i: float(x[i]) for i in sorted(met)}


def td_critic(rows: DataFrame, rate: float = 0.9, trace: float = 0.5) -> DataFrame:
    """(state, value): what an episode brings from a state on, by least-squares temporal differences."""
    values = solved(differences(rows, rate, trace))
    return rows.sparkSession.createDataFrame(list(values.items()), "state int, value double")
