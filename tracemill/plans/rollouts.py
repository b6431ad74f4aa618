"""Queries of rollout roll-ups, policy metrics, flows and sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions.common import array_sum, masked_sum, r6, ratio, sem
from tracemill.operators import groups as gr
from tracemill.operators import rollups as ru
from tracemill.operators import seqmath as sm
from tracemill.operators.nested import strict_json
from tracemill.plans.experiments import _ROLL, _UNI
from tracemill.plans.sequences import _PAIR, _pairs
from tracemill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Groups ---------------------------------------------------------------------------


@query("select chunk_id, count(*)::bigint as members, count(*) filter (trim(text) <> '')::bigint as filled from documents group by 1 having count(*) >= 5 and count(*) filter (trim(text) <> '') >= 5")
def valid_groups(spark, sf):
    return ru.valid_groups(table(spark, sf, "documents"), "chunk_id", F.col("text"), 5)


_GROUPS = "g as (select run_id, task_id, count(*) as members, count(reward) as scored, count(*) filter (reward >= 1) as correct from traces group by 1, 2)"


def _groups(spark, sf):
    return ru.scored_groups(table(spark, sf, "traces"), ["run_id", "task_id"], F.col("reward"))


@query(f"""with {_GROUPS} select run_id, count(*) filter (scored = members)::bigint as accepted, count(*) filter (scored <> members)::bigint as dropped,
round(count(*) filter (scored = members and correct = 0)::double / nullif(count(*) filter (scored = members), 0), 6) as all_wrong_rate, round(count(*) filter (scored <> members)::double / count(*), 6) as drop_rate from g group by 1""")
def group_rates(spark, sf):
    g = ru.group_rates(_groups(spark, sf), "run_id")
    return g.select("run_id", "accepted", "dropped", r6("all_wrong_rate").alias("all_wrong_rate"), r6("drop_rate").alias("drop_rate"))


@query(f"""with {_GROUPS} select case when scored < members then 'unscored' when correct = 0 then 'all_wrong' when correct = members then 'all_correct' else 'kept' end as reason, count(*)::bigint as n from g group by 1""")
def drop_reasons(spark, sf):
    why = F.when(F.col("scored") < F.col("members"), "unscored").when(F.col("correct") == 0, "all_wrong").when(F.col("correct") == F.col("members"), "all_correct").otherwise("kept")
    return _groups(spark, sf).groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("""with s as (select task_id, run_id, max((coalesce(reward, 0) > 0.5)::int) as s from traces group by 1, 2) select task_id, count(*)::bigint as rounds from s group by 1 having min(s) = 1 and count(*) > 1""")
def solved_everywhere(spark, sf):
    return ru.solved_everywhere(table(spark, sf, "traces"), "task_id", "run_id", F.coalesce("reward", F.lit(0.0)) > 0.5)


@query("""with v as (select run_id, pool_row, metadata::json as j from candidate_pool where json_valid(metadata) and json_type(metadata::json) = 'OBJECT'),
k as (select distinct run_id, pool_row, unnest(json_keys(j)) as name from v), n as (select run_id, count(distinct pool_row) as n from v group by 1)
select k.run_id, name from k join n using (run_id) group by 1, 2, n.n having count(*) = n.n""")
def common_names(spark, sf):
    v = F.try_variant_get(strict_json(F.col("metadata")), "$", "map<string,variant>")
    rows = table(spark, sf, "candidate_pool").select("run_id", "pool_row", v.alias("m")).where("m is not null")
    return ru.common_names(rows, "run_id", "pool_row", F.map_keys("m"))


@query(f"with {_ROLL} select l_partkey, l_orderkey, round(reward - avg(reward) over (partition by l_partkey), 6) as reward from ro")
def group_rewards(spark, sf):
    """A reward that needs its whole group: a grouped-aggregate Arrow UDF gives the group's figure, each rollout its distance."""

    @F.pandas_udf("double")
    def centre(rewards: pd.Series) -> float:
        return float(rewards.mean())

    rolls = gr.rollouts(table(spark, sf, "lineitem"), ["l_partkey"], "l_orderkey", (F.col("l_returnflag") == "R").cast("double")).select("l_partkey", "l_orderkey", "reward")
    return rolls.join(rolls.groupBy("l_partkey").agg(centre("reward").alias("c")), "l_partkey").select("l_partkey", "l_orderkey", r6(F.col("reward") - F.col("c")).alias("reward"))


# Policy metrics ---------------------------------------------------------------------


@query(f"""with {_PAIR}, k as (select vec_id, sum(case when m = 1 then o - n else 0 end) / greatest(sum(m), 1) as kl from tk group by 1)
select k.vec_id, round(kl, 6) as kl, case when label < 5 and kl > 0.01 then 0 else 1 end as keep from k join embeddings e on e.vec_id = k.vec_id""")
def sequence_kl_keep(spark, sf):
    kl = sm.sequence_kl(F.col("n"), F.col("o"), F.col("m"))
    return _pairs(spark, sf).select("vec_id", r6(kl).alias("kl"), sm.off_policy_keep(F.col("label") - F.lit(5), kl, 0.01).alias("keep"))


@query(f"""with {_PAIR} select vec_id, round(-avg(n) filter (m = 1), 5) as train_log_ppl, round(-avg(o) filter (m = 1), 5) as rollout_log_ppl, round(avg(o - n) filter (m = 1), 5) as kl,
round(avg(exp(n - o) - (n - o) - 1) filter (m = 1), 5) as k3, round(exp(avg(o - n) filter (m = 1)), 5) as ppl_ratio, round(avg(exp(2 * greatest(-20, least(20, n - o)))) filter (m = 1) - 1, 5) as chi2_token,
round(exp(2 * greatest(-20, least(20, sum(n - o) filter (m = 1)))) - 1, 4) as chi2_sequence from tk group by 1""")
def mismatch_metrics(spark, sf):
    got = sm.mismatch_metrics(F.col("n"), F.col("o"), F.col("m"))
    return _pairs(spark, sf).select("vec_id", *(F.round(c, 4 if name == "chi2_sequence" else 5).alias(name) for name, c in got.items()))


@query(f"""with {_PAIR}, a as (select tk.*, (label - 4.5) as reward, label % 3 as kind from tk join (select vec_id as v, label from embeddings) on v = vec_id),
b as (select vec_id, i, case kind when 0 then reward when 1 then reward * pow(0.9, 31 - i) else reward - 0.1 * (n - o) end as adv from a)
select vec_id, round(sum(adv), 5) as total, round(max(adv) filter (i = 0), 5) as first from b group by 1""")
def advantage_dispatch(spark, sf):
    """By kind: the reward at each token, discounted back from the end, or less a distillation penalty."""
    p = _pairs(spark, sf).withColumn("reward", F.col("label") - 4.5)
    steps = F.sequence(F.lit(0), F.lit(31))
    flat = F.transform(steps, lambda _: F.col("reward").cast("double"))
    back = F.transform(steps, lambda i: F.col("reward") * F.pow(F.lit(0.9), 31 - i))
    adv = F.when(F.col("label") % 3 == 0, flat).when(F.col("label") % 3 == 1, back).otherwise(sm.distilled(flat, F.col("n"), F.col("o"), 0.1))
    return p.select("vec_id", F.round(array_sum(adv), 5).alias("total"), F.round(F.element_at(adv, 1), 5).alias("first"))


@query(f"""with {_PAIR} select vec_id, (min(exp(n - o)) filter (m = 1) >= 0.7)::int as keep from tk group by 1""")
def veto_sequences(spark, sf):
    return _pairs(spark, sf).select("vec_id", sm.veto(F.col("n"), F.col("o"), F.col("m"), 0.7).alias("keep"))


@query(f"""with {_PAIR}, w as (select vec_id, n, o, m, exp(n - o) as w from tk), t as (select sum(w) filter (m = 1) / count(*) filter (m = 1) as mean from w)
select vec_id, round(avg(w / t.mean) filter (m = 1), 6) as weight from w cross join t group by 1""")
def batch_normalised_weights(spark, sf):
    """Token weights over the batch's mean weight, one scalar aggregate."""
    p = _pairs(spark, sf).withColumn("w", F.zip_with("n", "o", lambda n, o: F.exp(n.cast("double") - o.cast("double"))))
    mean = p.agg(F.sum(masked_sum(F.col("w"), F.col("m"))) / F.sum(masked_sum(F.col("m"), F.col("m")))).scalar()
    return p.select("vec_id", r6(sm.masked_mean(F.col("w"), F.col("m")) / mean).alias("weight"))


@query(f"""with {_PAIR} select vec_id, round(coalesce(sum(n) filter (m = 1), 0), 6) as total, round(coalesce(avg(n) filter (m = 1), 0), 6) as mean, round(coalesce(min(n) filter (m = 1), 0), 6) as least, round(coalesce(max(n) filter (m = 1), 0), 6) as most from tk group by 1""")
def masked_stats(spark, sf):
    own = F.transform(F.filter(F.arrays_zip("n", "m"), lambda x: x["m"] == 1), lambda x: x["n"].cast("double"))
    return _pairs(spark, sf).select("vec_id", r6(masked_sum(F.col("n"), F.col("m"))).alias("total"), r6(sm.masked_mean(F.col("n"), F.col("m"))).alias("mean"), r6(F.coalesce(F.array_min(own), F.lit(0.0))).alias("least"), r6(F.coalesce(F.array_max(own), F.lit(0.0))).alias("most"))


@query("""select user_id, sum(case when event_type = 'view' and event_id % 7 <> 0 then greatest(length(event_type) + event_id % 5 - 2, 0) else 0 end)::bigint as trained, sum(length(event_type) + event_id % 5)::bigint as tokens from events group by 1""")
def role_masks(spark, sf):
    """A user's events as a conversation: views stand for the assistant's turns; each seventh step is masked."""
    n = (F.length("event_type") + F.col("event_id") % 5).cast("int")
    turn = F.struct(F.when(F.col("event_type") == "view", "assistant").otherwise("user").alias("role"), n.alias("tokens"), F.when(F.col("event_id") % 7 == 0, 0).alias("step_loss_mask"))
    one = table(spark, sf, "events").select("user_id", sm.role_mask(F.array(turn), 2).alias("mask"))
    return one.groupBy("user_id").agg(F.sum(F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("trained"), F.sum(F.size("mask")).alias("tokens"))


# Logs ------------------------------------------------------------------------------


@query("""with r as (select l_orderkey, avg(l_discount) as d, avg(l_tax) as t from lineitem group by 1)
select 'l_discount' as metric, round(avg(d), 6) as value from r union all select 'l_tax', round(avg(t), 6) from r union all select 'l_quantity', round(avg(l_quantity), 6) from lineitem union all select 'l_extendedprice', round(max(l_extendedprice), 6) from lineitem""")
def log_rollup(spark, sf):
    out = ru.log_rollup(table(spark, sf, "lineitem"), "l_orderkey", ["l_discount", "l_tax"], ["l_quantity"], ["l_extendedprice"])
    return out.select("metric", r6("value").alias("value"))


@query("""select l_linestatus, count(*)::bigint as n, round(avg(l_quantity), 6) as mean_length, round(quantile_cont(l_quantity, 0.5), 6) as median_length, round(avg(l_discount), 6) as entropy from lineitem where l_returnflag = 'R' group by 1""")
def correct_only(spark, sf):
    ok = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return ok.groupBy("l_linestatus").agg(F.count("*").alias("n"), r6(F.avg("l_quantity")).alias("mean_length"), r6(F.percentile("l_quantity", F.lit(0.5))).alias("median_length"), r6(F.avg("l_discount")).alias("entropy"))


@query("""select event_type, round(sum(value), 4) as total, count(value)::bigint as laps, round(sum(length(props))::double / sum(value), 6) as per_second from events group by 1""")
def timers(spark, sf):
    t = ru.timers(table(spark, sf, "events"), "event_type", F.col("value"), F.length("props"))
    return t.select("event_type", F.round("total", 4).alias("total"), "laps", r6("per_second").alias("per_second"))


@query("""select run_id, count(*)::bigint as samples, round(avg(duration_ms), 4) as mean_ms, round(quantile_cont(duration_ms, 0.5), 4) as median_ms, max(duration_ms) as longest_ms,
round(avg((status is distinct from 'completed')::int), 6) as cut_share, round(avg((length(trace) > 4 * len(list_distinct(string_split(trace, ' '))) * 6)::int), 6) as repetitive_share from traces group by 1""")
def sample_metrics(spark, sf):
    repeats = F.length("trace") > 4 * F.size(F.array_distinct(F.split("trace", " "))) * 6
    return table(spark, sf, "traces").groupBy("run_id").agg(
        F.count("*").alias("samples"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.round(F.percentile("duration_ms", F.lit(0.5)), 4).alias("median_ms"), F.max("duration_ms").alias("longest_ms"),
        r6(F.avg((~F.col("status").eqNullSafe("completed")).cast("int"))).alias("cut_share"), r6(F.avg(repeats.cast("int"))).alias("repetitive_share"),
    )


_EP = """t as (select delivery_id, run_id, status, reward, duration_ms, case when json_valid(trace) then trace::json end as j from traces),
s as (select delivery_id, unnest(case when json_type(j->'$.steps') = 'ARRAY' then json_extract(j, '$.steps[*]') else [] end) as s from t where j is not null),
e as (select delivery_id, count(*) as steps, sum(try_cast(s->>'$.model.usage.total_tokens' as bigint)) as tokens, sum(try_cast(s->>'$.model.usage.prompt_tokens' as bigint)) as prompt_tokens, count(*) filter (s->>'$.environment.action_feedback.valid' = 'false') as invalid from s where json_type(s) = 'OBJECT' group by 1)"""


@query(f"""with {_EP} select run_id, count(*)::bigint as episodes, count(reward)::bigint as scored, round(avg(reward), 6) as mean_reward, round(stddev_samp(reward) / sqrt(count(reward)), 6) as sem_reward,
count(*) filter (status = 'completed')::bigint as completed, count(*) filter (status = 'failed')::bigint as failed, count(*) filter (status is null)::bigint as unknown, coalesce(sum(steps), 0)::bigint as steps,
sum(tokens)::bigint as tokens, sum(prompt_tokens)::bigint as prompt_tokens, round(sum(invalid)::double / nullif(sum(steps), 0), 6) as invalid_rate, round(avg(reward) filter (status = 'completed'), 6) as completed_reward,
count(*) filter (j is null)::bigint as torn, round(avg(duration_ms), 3) as mean_ms from t left join e using (delivery_id) group by 1""")
def full_run_summary(spark, sf):
    """Counts, coverage, reward with its error, outcome histogram, token totals and rates with NULL for an empty denominator, for each run."""
    v = strict_json(F.col("trace"))
    steps = F.when(F.schema_of_variant(F.try_variant_get("v", "$.steps", "variant")).startswith("ARRAY"), F.try_variant_get("v", "$.steps", "array<variant>"))
    rows = table(spark, sf, "traces").select("delivery_id", "run_id", "status", "reward", "duration_ms", v.alias("v")).withColumn("s", steps)
    objects = F.filter("s", lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    usage = lambda name: F.transform(objects, lambda x: F.try_variant_get(x, f"$.model.usage.{name}", "bigint"))
    known = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    total = lambda xs: F.when(F.size(known(xs)) > 0, F.aggregate(known(xs), F.lit(0).cast("bigint"), lambda a, x: a + x))
    invalid = F.size(F.filter(objects, lambda x: F.try_variant_get(x, "$.environment.action_feedback.valid", "string") == "false"))
    own = rows.select("run_id", "status", "reward", "duration_ms", F.col("v").isNull().alias("is_torn"), F.when(F.size(objects) > 0, F.size(objects)).alias("n"), total(usage("total_tokens")).alias("t"), total(usage("prompt_tokens")).alias("p"), F.when(F.size(objects) > 0, invalid).alias("i"))
    ok = F.col("status") == "completed"
    return own.groupBy("run_id").agg(
        F.count("*").alias("episodes"), F.count("reward").alias("scored"), r6(F.avg("reward")).alias("mean_reward"), r6(sem("reward")).alias("sem_reward"), F.count_if(ok).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isNull()).alias("unknown"), F.coalesce(F.sum("n"), F.lit(0)).alias("steps"), F.sum("t").alias("tokens"), F.sum("p").alias("prompt_tokens"), r6(ratio(F.sum("i"), F.sum("n"))).alias("invalid_rate"),
        r6(F.avg(F.when(ok, F.col("reward")))).alias("completed_reward"), F.count_if("is_torn").alias("torn"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"),
    )


# Flows and sampling -------------------------------------------------------------------


@query("""select event_id, row_number() over (order by ts, event_id) as place from events order by ts, event_id limit 100""")
def fifo_pop(spark, sf):
    return ru.fifo_pop(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 100).select("event_id", "place")


@query("""select run_id, indexed_at, row_number() over (order by indexed_at desc nulls last, run_id) as place from replay""")
def run_listing(spark, sf):
    """Newest first, undated last; the listing has a row for each run."""
    w = Window.orderBy(F.desc_nulls_last("indexed_at"), "run_id")
    return table(spark, sf, "replay").select("run_id", "indexed_at", F.row_number().over(w).alias("place"))


@query("""select delivery_id, run_id, (status is distinct from 'completed')::int as requeued, row_number() over (partition by run_id order by (status is distinct from 'completed')::int, delivered_at nulls last, delivery_id) as place from traces""")
def completion_order(spark, sf):
    t = table(spark, sf, "traces").select("delivery_id", "run_id", "delivered_at", "status")
    return ru.completion_order(t, "run_id", "delivered_at", ~F.col("status").eqNullSafe("completed"), "delivery_id").select("delivery_id", "run_id", "requeued", "place")


@query(f"""select c_custkey, round(-ln(1 - {_UNI.format("'w', c_custkey")}) / c_acctbal, 9) as draw from customer where c_acctbal > 0 order by -ln(1 - {_UNI.format("'w', c_custkey")}) / c_acctbal, c_custkey limit 50""")
def weighted_sample(spark, sf):
    return ru.weighted_sample(table(spark, sf, "customer"), "c_custkey", F.col("c_acctbal"), 50, "w").select("c_custkey", F.round("draw", 9).alias("draw"))


@query("""with e as (select c_custkey, e as epoch, (row_number() over (order by e, sha256('b:' || e || ':' || c_custkey), c_custkey) - 1) as seat from customer cross join (select unnest([0, 1, 2]) as e))
select c_custkey, epoch, (seat // 64)::bigint as batch_no, (seat % 64)::bigint as place, c as copy, (seat * 2 + c)::bigint as sample_no from e cross join (select unnest([0, 1]) as c)""")
def wrapped_batches(spark, sf):
    return ru.wrapped_batches(table(spark, sf, "customer"), "c_custkey", 64, 3, 2, "b")


@query("""select o_custkey, string_agg(case when o_orderstatus <> 'P' then o_orderpriority || ';' end, '' order by o_orderkey) as text, count(*) filter (o_orderstatus <> 'P')::bigint as parts, max_by(o_orderstatus, o_orderkey) filter (o_orderstatus = 'F') as finish_reason
from orders group by 1""")
def assembled_responses(spark, sf):
    delta = F.when(F.col("o_orderstatus") != "P", F.concat("o_orderpriority", F.lit(";")))
    out = ru.assembled(table(spark, sf, "orders"), "o_custkey", "o_orderkey", delta, F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")))
    return out.withColumn("text", F.nullif("text", F.lit("")))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as iso, epoch(date_trunc('second', ts))::bigint as seconds from events""")
def epoch_iso(spark, sf):
    seconds = F.unix_timestamp("ts")
    return table(spark, sf, "events").select("event_id", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), seconds.alias("seconds"))


@query("""select delivery_id, 'task-' || lpad(task_id::varchar, 6, '0') || '__sample-' || lpad(coalesce(sample_id, 0)::varchar, 3, '0') as uid, case when status = 'completed' then 'completed' when status = 'failed' then 'aborted' when reward is null then 'pending' else 'truncated' end as state, coalesce(reward, 0.0) as reward from traces""")
def buffer_samples(spark, sf):
    """Buffer records as samples: identifier, state by the reason it ended, reward."""
    state = F.when(F.col("status") == "completed", "completed").when(F.col("status") == "failed", "aborted").when(F.col("reward").isNull(), "pending").otherwise("truncated")
    uid = F.concat(F.lit("task-"), F.lpad(F.col("task_id").cast("string"), 6, "0"), F.lit("__sample-"), F.lpad(F.coalesce("sample_id", F.lit(0)).cast("string"), 3, "0"))
    return table(spark, sf, "traces").select("delivery_id", uid.alias("uid"), state.alias("state"), F.coalesce("reward", F.lit(0.0)).alias("reward"))
