"""All queries of the engine by name, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import table_functions
from tidemark.operators import attribution, bootstrap, company, decisions, demand, history, lru, paths, relational, replay, sketches, supervised, vector_index
from tidemark.sources import runs
from tidemark.sources.scratch import shared
from tidemark.sources.tables import LOG, raw_log, table, trace
from tidemark.streaming import ordered, sessions

#: Units of the unit-size and of the sized cache, capacities of the curve.
UNITS, SIZE_UNITS, CURVE = 30, 75, [10, 30, 75, 150]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_TRACE = """
    t as (select event_id, ts, user_id as folder, 1 + user_id % 7 as size, event_type as kind, value as reward from events),
    p as (select *, row_number() over (order by ts, event_id) as pos from t),
    q as (select *, lag(pos) over (partition by folder order by pos) as prev from p)"""
_DEPTH = """
    y as (select a.pos, sum(b.{w}) + any_value(a.{w}) as depth from {q} a join {q} b on b.pos > a.prev and b.pos < a.pos and coalesce(b.prev, 0) < a.prev group by a.pos),
    d as (select {q}.*, case when prev is not null then coalesce(depth, {w}) end as depth from {q} left join y using (pos))"""
_UNIT = _TRACE.replace("1 + user_id % 7 as size", "1 + user_id % 7 as size, 1 as one") + "," + _DEPTH.format(w="one", q="q")
_CLASSES = _UNIT + f""",
    c as (select *, case when size > {UNITS} then 'oversize' when prev is null then 'cold' when depth > {UNITS} then 'capacity' else 'hit' end as class from d)"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def unit(spark, sf) -> DataFrame:
    return lru.hits(lru.depths(trace(spark, sf)), UNITS)


def classes(spark, sf) -> DataFrame:
    return attribution.classed(lru.depths(trace(spark, sf)), UNITS)


@query("q01_position", f"with {_TRACE} select event_id, pos, prev from q")
def q01(spark, sf):
    return lru.placed(trace(spark, sf)).select("event_id", "pos", "prev")


@query("q02_lru_hits", f"with {_UNIT} select event_id, cast(depth as bigint) as depth, case when depth <= {UNITS} then 1 else 0 end as hit from d")
def q02(spark, sf):
    return unit(spark, sf).select("event_id", "depth", "hit")


@query("q03_lru_hits_sized", f"""
    with {_TRACE}, f as (select * from q where size <= {SIZE_UNITS}), {_DEPTH.format(w="size", q="f")}
    select event_id, size, case when depth <= {SIZE_UNITS} then 1 else 0 end as hit from d
    union all select event_id, size, 0 from q where size > {SIZE_UNITS}""")  # fmt: skip
def q03(spark, sf):
    return lru.sized(trace(spark, sf), SIZE_UNITS).select("event_id", "size", "hit")


@query("q03_lru_hits_oversize", f"""
    with {_TRACE}, f as (select event_id, folder, size, row_number() over (order by ts, event_id) as pos from t where size <= 5),
    g as (select *, lag(pos) over (partition by folder order by pos) as prev from f), {_DEPTH.format(w="size", q="g")}
    select event_id, size, case when depth <= 5 then 1 else 0 end as hit from d
    union all select event_id, size, 0 from t where size > 5""")  # fmt: skip
def q03b(spark, sf):
    return lru.sized(trace(spark, sf), 5).select("event_id", "size", "hit")


@query("q04_hit_curve", f"with {_UNIT} select cast(c as bigint) as capacity, count(*) filter (depth <= c) as n_hits, count(*) as n from d, unnest({CURVE}) as u(c) group by c")
def q04(spark, sf):
    return lru.hit_curve(lru.depths(trace(spark, sf)), CURVE)


_RATE = "count(*) as n, count(*) filter (depth <= {u}) as n_hits, count(*) filter (depth <= {u}) / cast(count(*) as double) as hit_rate".format(u=UNITS)


@query("q05_hit_rate_by_day", f"with {_UNIT} select cast(date_trunc('day', ts) as date) as day, {_RATE} from d group by 1")
def q05(spark, sf):
    return attribution.hit_rate(unit(spark, sf), F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date").alias("day"))


@query("q05_hit_rate_by_folder", f"with {_UNIT} select folder, {_RATE} from d group by 1")
def q05b(spark, sf):
    return attribution.hit_rate(unit(spark, sf), "folder")


@query("q06_miss_class", f"with {_CLASSES} select event_id, class from c")
def q06(spark, sf):
    return classes(spark, sf).select("event_id", "class")


@query("q07_attribution", f"""
    with {_CLASSES} select class, kind, day, cast(grouping_id(class, kind, day) as bigint) as level, count(*) as n
    from (select class, kind, cast(date_trunc('day', ts) as date) as day from c) group by grouping sets ((class, kind), (class, day), (class))""")  # fmt: skip
def q07(spark, sf):
    return attribution.by_dimension(classes(spark, sf))


@query("q08_worst_folders", f"with {_CLASSES} select folder, count(*) as n_misses from c where class = 'capacity' group by 1 order by 2 desc, 1 limit 10")
def q08(spark, sf):
    return attribution.worst(classes(spark, sf))


@query("q09_reuse_gaps", f"""
    with {_TRACE} select case when prev is null then 'none' when pos - prev <= 10 then 'upto_10' when pos - prev <= 100 then 'upto_100' else 'over_100' end as band, count(*) as n
    from q group by 1""")  # fmt: skip
def q09(spark, sf):
    return attribution.reuse_gaps(lru.placed(trace(spark, sf)))


_TOKENS = "select page_id, regexp_extract(url, '://([^/]*)', 1) as host, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) as segment from pages"


@query("q10_path_tokens", _TOKENS)
def q10(spark, sf):
    return paths.tokens(table(spark, sf, "pages"))


@query("q11_path_rollup", f"select host, segment, cast(grouping_id(host, segment) as bigint) as level, count(*) as n from ({_TOKENS}) group by rollup (host, segment)")
def q11(spark, sf):
    return paths.prefix_rollup(paths.tokens(table(spark, sf, "pages")))


@query("q12_hashed_vectors", """
    with w as (select page_id, unnest(list_filter(regexp_split_to_array(url, '[/:?#&=]+'), lambda x: x != '')) as token from pages)
    select page_id, cast(cast('0x' || left(sha256(token), 4) as bigint) % 32 as bigint) as bucket, count(*) as n from w group by 1, 2""")  # fmt: skip
def q12(spark, sf):
    return paths.hashed_counts(table(spark, sf, "pages"))


@query("q13_nearest_vectors", """
    with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
    s as (select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 4) as cosine from e a join e b on a.vec_id != b.vec_id where a.vec_id % 20 = 0)
    select query_id, vec_id, cosine, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from s qualify rank <= 5""")  # fmt: skip
def q13(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return paths.nearest_in_blocks(vectors, asked, decimals=4).withColumn("rank", F.col("rank").cast("long"))


@query("q13_nearest_vectors_whole", """
    with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
    s as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.v, b.v) as exact from e a join e b on a.vec_id != b.vec_id where a.vec_id % 20 = 0)
    select query_id, vec_id, round(exact, 4) as cosine, row_number() over (partition by query_id order by exact desc, vec_id) as rank from s qualify rank <= 5""")
def q13b(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = paths.nearest_in_blocks(vectors, asked)
    return near.select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("q14_trailing_count", f"with {_TRACE} select event_id, count(*) over (partition by folder order by ts range between interval 6 hours preceding and current row) as n_recent from t")
def q14(spark, sf):
    return history.trailing_count(trace(spark, sf), 6).select("event_id", "n_recent")


_BY = "over (partition by folder order by ts, event_id)"


@query("q15_since_last", f"with {_TRACE} select event_id, epoch_us(ts) - lag(epoch_us(ts)) {_BY} as gap_us from t")
def q15(spark, sf):
    return history.since_last(trace(spark, sf)).select("event_id", "gap_us")


_DEMAND = "dm as (select cast(date_trunc('day', ts) as date) as day, folder, count(*) as n, max((ts, event_id)) as last from t group by 1, 2)"


@query("q16_daily_demand", f"with {_TRACE}, {_DEMAND} select day, folder, n from dm")
def q16(spark, sf):
    return history.daily_demand(trace(spark, sf))


@query("q17_last_kinds", f"with {_TRACE} select event_id, coalesce(array_to_string(list(kind) over (partition by folder order by ts, event_id rows between 3 preceding and 1 preceding), ','), '') as last_kinds from t")
def q17(spark, sf):
    return history.last_kinds(trace(spark, sf)).select("event_id", "last_kinds")


@query("q18_decayed_score", f"""
    with {_TRACE} select a.event_id, round(coalesce(sum(exp(-(epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0)), 0), 4) as score
    from t a left join t b on a.folder = b.folder and (b.ts, b.event_id) < (a.ts, a.event_id) group by 1""")  # fmt: skip
def q18(spark, sf):
    return history.decayed(trace(spark, sf)).select("event_id", F.round("score", 4).alias("score"))


@query("q19_next_access", f"with {_TRACE} select event_id, case when epoch_us(lead(ts) {_BY}) - epoch_us(ts) <= 43200000000 then 1 else 0 end as label from t")
def q19(spark, sf):
    return history.next_within(trace(spark, sf), 12).select("event_id", "label")


@query("q20_split", "select event_id, case when cast('0x' || left(sha256(cast(event_id as varchar)), 8) as bigint) % 10 < 8 then 'train' else 'test' end as split from events")
def q20(spark, sf):
    return supervised.split(trace(spark, sf)).select("event_id", "split")


@query("q21_negatives", f"""
    with {_TRACE}, {_DEMAND},
    r as (select folder, row_number() over (order by sha256(cast(folder as varchar)), folder) - 1 as r, count(*) over () as f from (select distinct folder from t)),
    g as (select day, cast('0x' || left(sha256(cast(day as varchar)), 8) as bigint) as h from (select distinct day from dm))
    select day, folder, row_number() over (partition by day order by (r - h % f + f) % f) as rank
    from g, r where not exists (select 1 from dm where dm.day = g.day and dm.folder = r.folder) qualify rank <= 5""")  # fmt: skip
def q21(spark, sf):
    return supervised.negatives(trace(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("q22_training_rows", f"""
    with {_TRACE} select event_id, reward, count(*) over (partition by folder order by ts range between interval 24 hours preceding and current row) as n_recent,
    case when epoch_us(lead(ts) {_BY}) - epoch_us(ts) <= 21600000000 then 1 else 0 end as label from t""")  # fmt: skip
def q22(spark, sf):
    return supervised.training_rows(trace(spark, sf), 24, 6).select("event_id", "reward", "n_recent", "label")


@query("q23_actor_fit")
def q23(spark, sf):
    return supervised.fit_actor(supervised.training_rows(trace(spark, sf), 24, 6), ["n_recent", "reward"]).select("event_id", "label", "probability")


_LISTS = f"""{_TRACE}, {_DEMAND},
    pop as (select cast(day + 1 as date) as day, folder, row_number() over (partition by day order by n desc, folder) as rank from dm qualify rank <= 20),
    rec as (select cast(day + 1 as date) as day, folder, row_number() over (partition by day order by last desc, folder) as rank from dm qualify rank <= 20),
    can as (select day, folder from pop union select day, folder from rec)"""


@query("q24_candidates", f"with {_LISTS} select day, folder from can")
def q24(spark, sf):
    return supervised.candidates(trace(spark, sf))


@query("q25_recall", f"""
    with {_LISTS} select dm.day, count(*) as n, count(pop.folder) as n_found, count(pop.folder) / cast(count(*) as double) as recall
    from dm left join pop on dm.day = pop.day and dm.folder = pop.folder where dm.day in (select day from pop) group by 1""")  # fmt: skip
def q25(spark, sf):
    rows = trace(spark, sf)
    return supervised.recall(rows, supervised.popular(rows))


@query("q26_ranking_quality", f"""
    with {_LISTS} select day, round(1.0::double / min(rank), 4) as reciprocal_rank, round(sum(1 / log2(rank + 1)), 4) as dcg
    from dm join pop using (day, folder) group by 1""")  # fmt: skip
def q26(spark, sf):
    rows = trace(spark, sf)
    return supervised.ranking_quality(rows, supervised.popular(rows))


@query("q27_transitions", f"with {_TRACE} select event_id, folder, kind as state, reward, lead(kind) {_BY} as next_state, case when lead(event_id) {_BY} is null then 1 else 0 end as done from t")
def q27(spark, sf):
    return replay.transitions(trace(spark, sf))


@query("q28_discounted_return", f"with {_TRACE} select folder, round(sum(power(0.9::double, n - 1) * reward), 4) as return from (select *, row_number() {_BY} as n from t) group by 1")
def q28(spark, sf):
    return replay.discounted(trace(spark, sf))


@query("q29_three_step_return", f"with {_TRACE} select event_id, round(reward + 0.9::double * coalesce(lead(reward, 1) {_BY}, 0) + 0.81::double * coalesce(lead(reward, 2) {_BY}, 0), 4) as return_3 from t")
def q29(spark, sf):
    return replay.three_steps(trace(spark, sf))


@query("q30_critic_fit")
def q30(spark, sf):
    return replay.fit_critic(trace(spark, sf)).select("event_id", "future", "critic")


@query("q31_policy_fit")
def q31(spark, sf):
    return replay.fit_policy(trace(spark, sf)).select("event_id", "weight", "policy")


@query("q32_policy_replay")
def q32(spark, sf):
    return replay.replayed(trace(spark, sf), UNITS, 5.0)


@query("q33_ablation", f"""
    with {_LISTS}, c as (
        select 'popular' as list, count(*) as n_found from dm join pop using (day, folder)
        union all select 'recent', count(*) from dm join rec using (day, folder)
        union all select 'union', count(*) from dm join can using (day, folder))
    select list, n_found, n_found - (select n_found from c where list = 'union') as delta from c""")  # fmt: skip
def q33(spark, sf):
    return supervised.ablation(trace(spark, sf))


@query("q34_paired_capacities", f"""
    with {_UNIT} select case when depth <= 30 then 1 else 0 end as small, case when depth <= 75 then 1 else 0 end as large, count(*) as n from d group by 1, 2""")  # fmt: skip
def q34(spark, sf):
    deep = lru.depths(trace(spark, sf))
    small, large = (F.when(F.col("depth") <= c, 1).otherwise(0) for c in (30, 75))
    return deep.groupBy(small.alias("small"), large.alias("large")).agg(F.count("*").alias("n"))


@query("q35_json_props", """
    select event_type, count(k) as n_k, cast(sum(k) as bigint) as sum_k, count(*) as n
    from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1""")  # fmt: skip
def q35(spark, sf):
    return relational.props(table(spark, sf, "events").select("event_type", "props"))


@query("q36_cube", f"""
    with {_TRACE} select kind, size, cast(grouping_id(kind, size) as bigint) as level, count(*) as n, round(sum(reward), 2) as reward from t group by cube (kind, size)""")  # fmt: skip
def q36(spark, sf):
    return relational.cube(trace(spark, sf))


@query("q37_demand_ranks", f"""
    with {_TRACE}, c as (select kind, folder, count(*) as n from t group by 1, 2)
    select kind, folder, n, rank() over w as rank, dense_rank() over w as dense_rank, round(percent_rank() over w, 4) as percent_rank
    from c window w as (partition by kind order by n desc)""")  # fmt: skip
def q37(spark, sf):
    return relational.demand_ranks(trace(spark, sf))


@query("q38_folder_sets", f"""
    with {_TRACE}, a as (select folder from t where kind = 'purchase'), b as (select folder from t where kind = 'click')
    select folder, 'both' as part from (select * from a intersect select * from b)
    union all select folder, 'first' from (select * from a except select * from b)
    union all select folder, 'second' from (select * from b except select * from a)""")  # fmt: skip
def q38(spark, sf):
    return relational.folder_sets(trace(spark, sf), "purchase", "click")


@query("q39_as_of", f"""
    with {_TRACE} select event_id, last_value(case when kind = 'purchase' then event_id end ignore nulls) over w as last_id,
    last_value(case when kind = 'purchase' then reward end ignore nulls) over w as last_reward
    from t window w as (partition by folder order by ts, event_id rows between unbounded preceding and 1 preceding)""")  # fmt: skip
def q39(spark, sf):
    return relational.as_of(trace(spark, sf), "purchase")


@query("q40_within_an_hour", f"""
    with {_TRACE} select a.event_id as cause_id, b.event_id as effect_id, epoch_us(b.ts) - epoch_us(a.ts) as gap_us
    from t a join t b on a.folder = b.folder and a.kind = 'click' and b.kind = 'purchase' and b.ts > a.ts and b.ts <= a.ts + interval 60 minutes""")  # fmt: skip
def q40(spark, sf):
    return relational.within(trace(spark, sf), "click", "purchase", 60)


@query("q41_distinct_folders", f"with {_TRACE} select kind, count(distinct folder) as n_folders from t group by 1")
def q41(spark, sf):
    return relational.reach(trace(spark, sf)).select("kind", "n_folders")


@query("q42_demand_forecast", f"""
    with {_TRACE}, {_DEMAND}
    select a.folder, a.day, a.n, round(coalesce(sum(b.n), 0) / 3.0::double, 4) as forecast
    from dm a left join dm b on a.folder = b.folder and b.day < a.day and b.day >= a.day - 3 group by 1, 2, 3""")  # fmt: skip
def q42(spark, sf):
    return relational.demand_forecast(trace(spark, sf))


@query("q43_path_vectors")
def q43(spark, sf):
    pages = table(spark, sf, "pages")
    return paths.encoded_paths(paths.path_encoder(pages), pages)


# Decisions

_DECISIONS = _TRACE.split("p as (")[0].rstrip().rstrip(",") + """,
    d0 as (select event_id, folder, cast(date_trunc('day', ts) as date) as day, ts, size, reward as seen, cast((least(size, 7) - 1) * 4 + (reward >= 10)::int + (reward >= 50)::int + (reward >= 100)::int as int) as state,
           (kind = 'purchase')::int as action from t),
    dec as (select *, cast(row_number() over o - 1 as int) as t, coalesce(lead(seen) over o, 0) as reward, lead(state) over o as next_state from d0 window o as (partition by folder, day order by ts, event_id)),
    beh as (select state, (sum(action) + 1) / (count(*) + 2.0::double) as behaviour from dec group by 1),
    tgt as (select *, 1 / (1 + exp(-(0.3::double * size - 0.02::double * seen))) as target from dec join beh using (state))"""
_BACKUPS = """
    pol as (select state, avg(target) as p from tgt group by 1),
    r1 as (select state, action, avg(reward) as q from dec group by 1, 2),
    v1 as (select state as next_state, sum(case when action = 1 then p else 1 - p end * q) as v from r1 join pol using (state) group by 1),
    r2 as (select state, action, avg(reward + 0.9::double * coalesce(v, 0)) as q from dec left join v1 using (next_state) group by 1, 2)"""


def logistic(rows: DataFrame) -> DataFrame:
    """Append target, the probability of action 1 of a policy that is given."""
    return rows.withColumn("target", 1 / (1 + F.exp(-(0.3 * F.col("size") - 0.02 * F.col("seen")))))


def rounded(told: DataFrame) -> DataFrame:
    return told.withColumns({c: F.round(c, 4) for c in ("value", "std_error", "effective")})


@query("q44_policy_value", f"""
    with {_DECISIONS}, {_BACKUPS},
    bs as (select state, coalesce(max(q) filter (action = 0), 0) as q0, coalesce(max(q) filter (action = 1), 0) as q1 from r2 group by 1),
    x as (select folder, day, t, reward, case when action = 1 then target / behaviour else (1 - target) / (1 - behaviour) end as ratio,
                 case when action = 1 then q1 else q0 end as q, target * q1 + (1 - target) * q0 as v from tgt join bs using (state)),
    w as (select *, product(ratio) over o as weight, coalesce(lead(v) over o, 0) as v_next, power(0.9::double, t) as fade from x window o as (partition by folder, day order by t)),
    e as (select folder, day, sum(fade * reward) as logged, sum(fade * weight * reward) as per_decision,
                 max(v) filter (t = 0) + sum(fade * weight * (reward + 0.9::double * v_next - q)) as doubly_robust, arg_max(weight, t) as last, count(*) as length from w group by 1, 2),
    n as (select count(*) as n, sum(last) * sum(last) / sum(last * last) as effective from e),
    st as (select t, sum(weight * reward) as gain, sum(weight) as weight from w group by 1),
    sn as (select sum(power(0.9::double, st.t) * st.gain / (st.weight + (select coalesce(sum(last), 0) from e where length <= st.t))) as value from st)
    select estimator, round(value, 4) as value, round(std_error, 4) as std_error, n as n_episodes, round(case when estimator = 'logged' then n else effective end, 4) as effective
    from (select 'logged' as estimator, avg(logged) as value, stddev_samp(logged) / sqrt(count(*)) as std_error from e
          union all select 'per_decision', avg(per_decision), stddev_samp(per_decision) / sqrt(count(*)) from e
          union all select 'doubly_robust', avg(doubly_robust), stddev_samp(doubly_robust) / sqrt(count(*)) from e
          union all select 'self_normalised', value, null from sn) cross join n""")  # fmt: skip
def q44(spark, sf):
    """Three off-policy estimates of a policy that is given, and what was logged."""
    rows = logistic(decisions.frequencies(decisions.decisions(trace(spark, sf))))
    policy, made = rows.groupBy("state").agg(F.avg("target").alias("p")), decisions.moves(rows)
    q = decisions.backup(made, decisions.backup(made, None, 0.9, policy), 0.9, policy)
    return rounded(decisions.evaluated(rows, 0.9, q))


@query("q45_trained_policy_value")
def q45(spark, sf):
    """The policy of rl-train-actor, saved and loaded again, by logged decisions."""
    rows, folder = trace(spark, sf), f"{shared(spark)}/q45-{uuid.uuid4().hex}"
    runs.save_model(replay.policy_model(replay.weighed(replay.critic_model(rows), rows)), folder, "rl-train-actor", "q45")
    return rounded(decisions.trained_value(decisions.decisions(rows), runs.load_model(folder, "rl-train-actor", "q45")))


@query("q46_td_matrix", f"""
    with {_DECISIONS},
    z as (select b.folder, b.day, b.t, b.state, b.next_state, b.reward, a.state as i, sum(power(0.9::double * 0.517::double, b.t - a.t)) as z
          from dec a join dec b on a.folder = b.folder and a.day = b.day and a.t <= b.t group by all),
    c as (select i, state as j, z as x from z union all select i, next_state, -0.9::double * z from z where next_state is not null union all select i, -1, z * reward from z)
    select i, j, round(sum(x), 4) as value from c group by 1, 2 having sum(x) != 0""")  # fmt: skip
def q46(spark, sf):
    """The system of the critic by temporal differences, with eligibility traces."""
    return decisions.differences(decisions.decisions(trace(spark, sf)), 0.9, 0.517).withColumn("value", F.round("value", 4))


@query("q47_td_critic")
def q47(spark, sf):
    """Each state's value by the solution of that system."""
    return decisions.td_critic(decisions.decisions(trace(spark, sf)), 0.9, 0.517).withColumn("value", F.round("value", 4))


@query("q48_fitted_q", f"""
    with recursive {_DECISIONS},
    mv as (select state, action, next_state, count(*) as n, sum(reward) as r from dec group by all),
    s as (select distinct state, action from mv),
    it as (select 0 as k, state, action, 0.0::double as q from s
           union all
           select * from (
               with v as (select state as next_state, max(q) as v, max(k) as k from it group by 1)
               select (select max(k) from v) + 1, mv.state, mv.action, sum(r + 0.9::double * n * coalesce(v, 0)) / sum(n) from mv left join v using (next_state) where (select max(k) from v) < 150 group by mv.state, mv.action))
    select state, action, round(q, 3) as q, action = arg_max(action, q) over (partition by state) as best from it where k = 150""")  # fmt: skip
def q48(spark, sf):
    """Values of actions at the fixed point of the backups, and which is best."""
    q, _ = decisions.fitted_q(decisions.decisions(trace(spark, sf)))
    best = decisions.greedy(q, explore=0.0).select("state", F.col("p").cast("int").alias("__best"))
    return q.join(best, "state").select("state", "action", F.round("q", 3).alias("q"), (F.col("action") == F.col("__best")).alias("best"))


@query("q49_greedy_policy_value")
def q49(spark, sf):
    """What the best actions by q48 would have brought, one decision in ten left to chance."""
    rows = decisions.frequencies(decisions.decisions(trace(spark, sf)))
    return rounded(decisions.greedy_value(rows))


@query("q50_actor_recall")
def q50(spark, sf):
    """How good the actor's own ranks of its candidates are, day by day."""
    rows = trace(spark, sf)
    return supervised.actor_quality(supervised.actor_model(supervised.training_rows(rows, 24, 6), ["n_recent", "reward"]), rows)


@query("q51_indexed_nearest")
def q51(spark, sf):
    """q13's questions by the index: cells, table sums, exact cosines of the best."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as q")
    return vector_index.nearest(vectors, queries)


_FOLDED = _TRACE + """,
    dn as (select cast(date_trunc('day', ts) as date) as day, folder, count(*) as n from t group by 1, 2),
    fd as (select folder, min(day) as first from dn group by 1),
    fl as (select fd.folder, cast(first + cast(i as int) as date) as day, i, coalesce(n, 0) as n
           from (select folder, first, unnest(range(0, (select max(day) from dn) - first + 1)) as i from fd) fd left join dn on fd.folder = dn.folder and dn.day = first + cast(i as int)),
    fc as (select folder, i, day, n, cast(n as double) as z, 1.0::double as x, 1.0::double as p, 1.0::double as gone, null::double as croston, null::double as sba, null::double as tsb from fl where i = 0
           union all
           select fl.folder, fl.i, fl.day, fl.n, case when fl.n > 0 then z + 0.2::double * (fl.n - z) else z end, case when fl.n > 0 then x + 0.2::double * (gone - x) else x end,
                  p + 0.1::double * (case when fl.n > 0 then 1 else 0 end - p), case when fl.n > 0 then 1 else gone + 1 end, z / x, 0.9::double * (z / x), p * z
           from fc join fl on fc.folder = fl.folder and fl.i = fc.i + 1)"""


@query("q52_intermittent_forecast", f"""
    with recursive {_FOLDED} select folder, day, n, round(croston, 4) as croston, round(sba, 4) as sba, round(tsb, 4) as tsb from fc where i > 0""")  # fmt: skip
def q52(spark, sf):
    return demand.forecasts(trace(spark, sf)).withColumns({m: F.round(m, 4) for m in demand.METHODS})


@query("q53_forecast_error", f"""
    with recursive {_FOLDED},
    w as (select *, (sum(n) over (partition by folder order by i rows between 3 preceding and 1 preceding)) / 3.0::double as mean3, lag(n) over (partition by folder order by i) as naive from fc where i > 0),
    e as (select unnest(['croston', 'sba', 'tsb', 'mean3', 'naive']) as method, unnest([croston, sba, tsb, mean3, naive]) - n as e from w where i > 3)
    select method, count(*) as n, round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse, round(avg(e), 4) as bias from e group by 1""")  # fmt: skip
def q53(spark, sf):
    """Each method's error with a rolling origin, beside that of q42's mean."""
    return demand.errors(demand.forecasts(trace(spark, sf))).withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "bias")})


@query("q54_month_of_sketches")
def q54(spark, sf):
    """Distinct folders and quantiles of rewards of 30 days by kind, from the sketches of each day."""
    path = f"{shared(spark)}/sketches-{uuid.uuid4().hex}"
    sketches.store(sketches.daily(trace(spark, sf)), path)
    return sketches.over(sketches.stored(spark, path), date(2024, 1, 1), date(2024, 1, 30))


@query("q55_sketch_bounds", f"""
    with {_TRACE} select kind, count(*) as n, count(distinct folder) as n_folders, true as folders_within, true as q50_within, true as q90_within, true as q99_within from t group by 1""")  # fmt: skip
def q55(spark, sf):
    """Whether the bounds that the sketches tell hold for what is exact."""
    rows = trace(spark, sf)
    return sketches.held(sketches.over(sketches.daily(rows)), rows)


_CDF = bootstrap.thresholds()


@query("q56_ablation_intervals", f"""
    with {_LISTS}, un as (select distinct day, folder from pop union select distinct day, folder from rec),
    u as (select dm.day, dm.folder, (pop.folder is not null)::bigint as popular, (rec.folder is not null)::bigint as recent, (un.folder is not null)::bigint as both_
          from dm left join pop on dm.day = pop.day and dm.folder = pop.folder left join rec on dm.day = rec.day and dm.folder = rec.folder left join un on dm.day = un.day and dm.folder = un.folder),
    l as (select day, folder, unnest(['popular', 'recent', 'union']) as list, unnest([popular, recent, both_]) as hit, unnest([popular - both_, recent - both_, 0]) as d from u),
    h as (select day, folder, g, sha256(day::varchar || ':' || folder::varchar || ':' || g::varchar) as h from u, (select unnest(range(25)) as g)),
    w as (select day, folder, g * 8 + j as b, cast('0x' || substr(h, 8 * j + 1, 8) as bigint) as x from (select *, unnest(range(8)) as j from h)),
    r as (select list, b, sum(d * ({" + ".join(f"(x >= {t})::bigint" for t in _CDF)})) as s from l join w using (day, folder) group by 1, 2),
    o as (select list, s, row_number() over (partition by list order by s, b) - 1 as i from r)
    select list, cast(sum(hit) as bigint) as n_found, cast(sum(d) as bigint) as delta,
           cast((select s from o where o.list = l.list and i = 5) as bigint) as low, cast((select s from o where o.list = l.list and i = 194) as bigint) as high from l group by list""")  # fmt: skip
def q56(spark, sf):
    """q33's deltas with intervals of 95 % from 200 replicates."""
    rows = trace(spark, sf)
    lists = {"popular": supervised.popular(rows), "recent": supervised.recent(rows), "union": supervised.candidates(rows)}
    return bootstrap.ablation_intervals(history.daily_demand(rows), lists, "union")


# Streams: the table as it arrives, up to where the watermark has come

_PASSED = "(select (epoch_us(max(ts)) // 1000 - 7200000) * 1000 from events)"


def arriving(spark, sf) -> DataFrame:
    """The events table as a stream; it may be a file or a folder, or a raw log as kind:path."""
    raw = raw_log(spark, sf, stream=True)
    return raw if raw is not None else spark.readStream.schema(LOG).parquet(f"{sf}/events.parquet*")


def streamed(spark, sf, begin) -> str:
    """Run a stream to its end with state in RocksDB; the folder it wrote to."""
    folder, provider = f"{shared(spark)}/stream-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ordered.PROVIDER)
    try:
        begin(f"{folder}/out", f"{folder}/checkpoint", raw_log(spark, sf) is not None).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return f"{folder}/out"


@query("q57_stream_in_order", f"""
    with o as (select user_id as folder, event_id, epoch_us(ts) as us, value, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events)
    select folder, event_id, us, value, case when gap <= 604800000000 then gap end as gap_us from o where us <= {_PASSED}""")  # fmt: skip
def q57(spark, sf):
    """Accesses in order with the gap before each, by a stateful stream."""
    out = streamed(spark, sf, lambda *to: ordered.to_tables(ordered.in_order(arriving(spark, sf)), *to))
    return spark.read.parquet(f"{out}/ordered").select("folder", "event_id", "us", "value", "gap_us")


@query("q58_stream_sessions", f"""
    with a as (select user_id as folder, ts, value, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by folder order by ts rows unbounded preceding) as k from a)
    select folder, epoch_us(min(ts)) as start_us, count(*) as n, round(sum(value), 4) as reward from s group by folder, k having epoch_us(max(ts)) + 1800000000 <= {_PASSED}""")  # fmt: skip
def q58(spark, sf):
    """Sessions with pauses under half an hour, by a stream."""
    rows = arriving(spark, sf).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours")
    out = streamed(spark, sf, lambda *to: sessions.to_folder(sessions.sessions(rows), *to))
    return spark.read.parquet(out).select("folder", F.unix_micros("start").alias("start_us"), "n", F.round("reward", 4).alias("reward"))


@query("q59_company_weights", f"""
    with {_TRACE}, v as (select epoch_us(ts) // 3600000000 as session, 'log://host/' || folder::varchar || '/' || kind as path, ts, event_id from t where folder is not null),
    o as (select session, path, row_number() over (partition by session order by ts, event_id) as place from v),
    pr as (select a.path as a, b.path as b from o a join o b on a.session = b.session and b.place > a.place and b.place <= a.place + 5 and a.path != b.path),
    c as (select a, b, count(*) as n from (select a, b from pr union all select b, a from pr) group by 1, 2),
    m as (select a, sum(n) as m from c group by 1)
    select c.a, c.b, round(ln(cast(n as double) * (select sum(n) from c) / (cast(ma.m as double) * mb.m)), 4) as w
    from c join m ma on c.a = ma.a join m mb on c.b = mb.a where ln(cast(n as double) * (select sum(n) from c) / (cast(ma.m as double) * mb.m)) > 0""")  # fmt: skip
def q59(spark, sf):
    """How much commoner than chance two paths stand together."""
    return company.weighed(company.pairs(company.visits(trace(spark, sf)))).withColumn("w", F.round("w", 4))


@query("q60_company_vectors")
def q60(spark, sf):
    """Each path's vector by its company."""
    return company.company_vectors(company.visits(trace(spark, sf)))


_DRAWN = "cast('0x' || substr(sha256(user_id::varchar), 1, 8) as bigint) % 64"
_SAMPLED = _UNIT.replace("from events)", f"from events where {_DRAWN} % 4 = 0)").replace("user_id as folder,", f"user_id as folder, {_DRAWN} as g,")


@query("q61_sampled_curve", f"""
    with {_SAMPLED},
    f as (select cast(count(distinct user_id) as double) / (select count(distinct folder) from t) as scale from events),
    s as (select c, g, cast(count(*) as double) as n, cast(count(*) filter ((depth - 1) * (select scale from f) + 1 <= c) as double) as h from d, unnest({CURVE}) as u(c) group by 1, 2),
    a as (select c, sum(n) as n, sum(h) as h, sum(h * h) as hh, sum(h * n) as hn, sum(n * n) as nn, sum(h) / sum(n) as r from s group by c)
    select cast(k.c as bigint) as capacity, cast(coalesce(n, 0) as bigint) as n_sampled, round(r, 6) as hit_rate, round(sqrt(16 / 15.0 * greatest(0.0, hh - 2 * r * hn + r * r * nn)) / n, 6) as error from unnest({CURVE}) as k(c) left join a on k.c = a.c""")  # fmt: skip
def q61(spark, sf):
    """q04's rates from a quarter of the folders, with standard errors."""
    out = lru.sampled_curve(trace(spark, sf), CURVE, 4)
    return out.withColumns({"hit_rate": F.round("hit_rate", 6), "error": F.round("error", 6)})


@query("q62_running_decay", """
    select a.event_id, a.user_id as folder, round(sum(b.value * pow(2, -(epoch_us(a.ts) - epoch_us(b.ts)) / 3.6e9 / 24)), 4) as decayed
    from events a join events b on a.user_id is not distinct from b.user_id and b.ts <= a.ts group by 1, 2""")  # fmt: skip
def q62(spark, sf):
    """Each folder's reward so far, halved every 24 hours, by a table function."""
    table_functions.register(spark)
    accesses = trace(spark, sf).select("event_id", "folder", "ts", "reward")
    return spark.sql("""
        select event_id, folder, round(decayed, 4) as decayed
        from running_decay(TABLE({accesses}), key => 'folder', at => 'ts', value => 'reward', half_life => 24.0)""", accesses=accesses)  # fmt: skip


@query("q63_gap_sessions", """
    with a as (select event_id, user_id as folder, ts, case when ts - lag(ts) over w <= interval 6 hours then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by folder order by ts rows unbounded preceding) as k from a)
    select event_id, folder, cast(k as bigint) as session, row_number() over (partition by folder, k order by ts) as place from s""")  # fmt: skip
def q63(spark, sf):
    """Each access's session, ended by a pause of over six hours, by a table function."""
    table_functions.register(spark)
    accesses = trace(spark, sf).select("event_id", "folder", "ts")
    return spark.sql("select event_id, folder, session, place from gap_sessions(TABLE({accesses}), key => 'folder', at => 'ts', gap => 21600)", accesses=accesses)


@query("q64_sized_miss_class", f"""
    with {_TRACE}, f as (select event_id, folder, size, row_number() over (order by ts, event_id) as pos from t where size <= 5),
    g as (select *, lag(pos) over (partition by folder order by pos) as prev from f), {_DEPTH.format(w="size", q="g")}
    select event_id, size, case when prev is null then 'cold' when depth > 5 then 'capacity' else 'hit' end as class from d
    union all select event_id, size, 'oversize' from t where size > 5""")  # fmt: skip
def q64(spark, sf):
    """Why each access misses a cache of 5 units of folder size, which the largest folders never fit."""
    return attribution.classed(lru.sized(trace(spark, sf), 5), 5).select("event_id", "size", "class")
