"""Queries over event episodes: describes, histograms, state, streaks, windows, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.common import nearest_rank, r6, ratio
from tracemill.operators import episodes as ep
from tracemill.sources.tables import table

KEY, ORDER = ["user_id", "day"], ["ts", "event_id"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_EV = "ev as (select event_id, ts, user_id, event_type, value, cast(ts as date) as day, cast(json_extract_string(props, '$.k') as int) as k from events)"
_EP = f"""{_EV},
rv as (select *, case when k is not null and row_number() over (partition by user_id, day, k order by ts, event_id) > 1 then 1 else 0 end as revisit from ev),
e0 as (select user_id, day, count(*)::bigint as steps, count(*) filter (event_type = 'error')::bigint as errors, count(*) filter (event_type = 'purchase')::bigint as purchases,
  count(distinct k)::bigint as products, sum(revisit)::bigint as revisits, sum(value) as value, min(ts) as started from rv group by 1, 2),
ep as (select *, case when errors = steps then 'technical' when purchases > 0 then 'success' else 'failure' end as outcome from e0)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _metric(name: str) -> str:
    return f"round(avg({name}::double), 6) as {name}_mean, round(quantile_cont({name}::double, 0.5), 6) as {name}_median, round(quantile_cont({name}::double, 0.9), 6) as {name}_p90"


@query(f"""with {_EP} select outcome, count(*)::bigint as n, count(distinct user_id)::bigint as ids,
round(avg(case outcome when 'success' then 1.0 when 'failure' then 0.0 end), 6) as success_rate, {_metric('steps')}, {_metric('value')},
round(sum(value) / sum(steps), 6) as value_per_step, round(avg((errors > 0)::int), 6) as any_error from ep group by outcome""")
def behavior_describe(spark, sf):
    """The flagship: episodes by outcome."""
    rows = ep.event_episodes(_events(spark, sf))
    d = ep.describe(rows, ["outcome"], ["steps", "value"], "user_id", F.col("reward"))
    extra = rows.groupBy("outcome").agg(r6(ratio(F.sum("value"), F.sum("steps"))).alias("value_per_step"), r6(F.avg((F.col("errors") > 0).cast("int"))).alias("any_error"))
    return d.join(extra, "outcome")


@query(f"""with {_EP} select outcome, day, grouping_id(outcome, day)::bigint as level, count(*)::bigint as n, round(avg(steps), 6) as mean_steps
from ep group by grouping sets ((outcome), (day), (outcome, day), ())""")
def behavior_grouping_sets(spark, sf):
    e = ep.event_episodes(_events(spark, sf))
    sets = e.groupingSets([["outcome"], ["day"], ["outcome", "day"], []], "outcome", "day")
    return sets.agg(F.grouping_id("outcome", "day").cast("bigint").alias("level"), F.count("*").alias("n"), r6(F.avg("steps")).alias("mean_steps"))


@query(f"""with {_EV} select event_type, count(*)::bigint as n, {_metric('value')} from ev group by 1""")
def phase_percentiles(spark, sf):
    p = F.percentile(F.col("value"), F.array(F.lit(0.5), F.lit(0.9)))
    return ep.event_steps(_events(spark, sf)).groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("value_mean"), r6(p[0]).alias("value_median"), r6(p[1]).alias("value_p90"))


@query(f"""with {_EP}, u as (unpivot (select outcome, steps, errors, revisits from ep) on steps, errors, revisits into name metric value v)
select outcome, metric, v as bin, count(*)::bigint as n from u group by all""")
def metric_histograms(spark, sf):
    e = ep.event_episodes(_events(spark, sf)).select("outcome", "steps", "errors", "revisits")
    return e.unpivot(["outcome"], ["steps", "errors", "revisits"], "metric", "bin").groupBy("outcome", "metric", "bin").agg(F.count("*").alias("n"))


@query(f"""with {_EP}, h as (select steps, count(*) as c from ep group by 1)
select steps, round(sum(c) over (order by steps) / sum(c) over (), 6) as share from h""")
def episode_length_ecdf(spark, sf):
    h = ep.event_episodes(_events(spark, sf)).groupBy("steps").agg(F.count("*").alias("c"))
    w = Window.orderBy("steps")  # over distinct lengths, a small table
    return h.select("steps", r6(ratio(F.sum("c").over(w), F.sum("c").over(Window.partitionBy()))).alias("share"))


@query(f"""with {_EV}, d as (select day, avg(value) as m from ev group by 1)
select day, round(avg(m) over (order by day rows between 4 preceding and current row), 6) as trailing from d""")
def daily_trailing_mean(spark, sf):
    d = ep.event_steps(_events(spark, sf)).groupBy("day").agg(F.avg("value").alias("m"))
    return d.select("day", r6(F.avg("m").over(Window.orderBy("day").rowsBetween(-4, 0))).alias("trailing"))


@query(f"""with {_EV} select event_id, last_value(case when event_type in ('view', 'click') then k end ignore nulls) over
(partition by user_id, day order by ts, event_id rows between unbounded preceding and 1 preceding) as seen from ev""")
def state_before_action(spark, sf):
    state = F.when(F.col("event_type").isin("view", "click"), F.col("k"))
    return ep.state_before(ep.event_steps(_events(spark, sf)), state, KEY, ORDER, "seen").select("event_id", "seen")


@query(f"""with {_EP} select user_id, day, products, revisits from ep""")
def revisits(spark, sf):
    return ep.event_episodes(_events(spark, sf)).select("user_id", "day", "products", "revisits")


@query(f"""with {_EV} select user_id, day, k as first_rank from ev where event_type = 'purchase'
qualify row_number() over (partition by user_id, day order by ts, event_id) = 1""")
def first_nonnull_rank(spark, sf):
    rows = ep.event_steps(_events(spark, sf)).where("event_type = 'purchase' and k is not null")
    return rows.groupBy("user_id", "day").agg(F.min_by("k", F.struct(*ORDER)).alias("first_rank"))


@query(f"""with {_EV}, c as (select user_id, event_type, case when k <> lag(k) over (partition by user_id, event_type order by ts, event_id) then 1 else 0 end as changed from ev)
select user_id, sum(changed)::bigint as changes from c group by 1""")
def option_changes(spark, sf):
    rows = ep.option_changes(ep.event_steps(_events(spark, sf)), "event_type", "k", ["user_id"], ORDER)
    return rows.groupBy("user_id").agg(F.sum("changed").alias("changes"))


@query(f"""with {_EV} select user_id, k, event_id, event_type, count(*) over (partition by user_id, k)::bigint as attempts from ev
qualify row_number() over (partition by user_id, k order by ts desc, event_id desc) = 1""")
def latest_record_wins(spark, sf):
    rows = ep.event_steps(_events(spark, sf)).select("user_id", "k", "ts", "event_id", "event_type")
    return ep.latest_record(rows, ["user_id", "k"], ORDER).drop("ts")


@query(f"""with {_EV}, m as (select *, max((event_type = 'purchase')::int) over (partition by user_id, k order by ts, event_id rows between unbounded preceding and 1 preceding) as done from ev)
select event_id, user_id, k from m where done = 1""")
def attempt_after_complete(spark, sf):
    rows = ep.event_steps(_events(spark, sf))
    return ep.after_complete(rows, F.col("event_type") == "purchase", ["user_id", "k"], ORDER).select("event_id", "user_id", "k")


@query(f"""with {_EV}, n as (select *, row_number() over (partition by user_id, day order by ts, event_id) as i from ev)
select a.event_id, round(sum(b.value * pow(0.904837418035, b.i - a.i)), 6) as ret from n a join n b on a.user_id = b.user_id and a.day = b.day and b.i >= a.i group by 1""")
def discounted_returns(spark, sf):
    arrays = _step_arrays(spark, sf)
    z = F.arrays_zip("ids", ep.discounted_returns(F.col("rewards"), 0.904837418035).alias("ret"))
    return arrays.select(F.inline(F.transform(z, lambda x: F.struct(x["ids"].alias("event_id"), F.round(x["ret"], 6).alias("ret")))))


def _step_arrays(spark, sf) -> DataFrame:
    steps = ep.event_steps(_events(spark, sf))
    s = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value", "k")))  # an episode is a user's day
    return steps.groupBy("user_id", "day").agg(s.alias("s")).select(
        F.transform("s", lambda x: x["event_id"]).alias("ids"), F.transform("s", lambda x: x["value"]).alias("rewards"), F.transform("s", lambda x: x["k"].cast("double")).alias("vals")
    )


@query(f"""with {_EV}, n as (select *, k::double as v, row_number() over (partition by user_id, day order by ts, event_id) as i from ev),
d as (select *, value + 0.904837418035 * coalesce(lead(v) over (partition by user_id, day order by ts, event_id), 0) - v as delta from n)
select a.event_id, round(sum(b.delta * pow(0.904837418035 * 0.953247917, b.i - a.i)), 5) as advantage from d a join d b on a.user_id = b.user_id and a.day = b.day and b.i >= a.i group by 1""")
def gae(spark, sf):
    arrays = _step_arrays(spark, sf)
    z = F.arrays_zip("ids", ep.gae(F.col("rewards"), F.col("vals"), 0.904837418035, 0.953247917).alias("adv"))
    return arrays.select(F.inline(F.transform(z, lambda x: F.struct(x["ids"].alias("event_id"), F.round(x["adv"], 5).alias("advantage")))))


@query(f"""with {_EV} select date_trunc('hour', ts) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from ev group by 1, 2""")
def tumbling_windows(spark, sf):
    """Extension: tumbling hours."""
    return ep.event_steps(_events(spark, sf)).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query(f"""with {_EV}, s as (select ts, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start from ev)
select start, count(*)::bigint as n, round(sum(value), 4) as total from s group by 1""")
def sliding_windows(spark, sf):
    """Extension: two hours, every hour."""
    return ep.event_steps(_events(spark, sf)).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


@query(f"""with {_EV}, g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as starts from ev),
s as (select *, sum(starts) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from g)
select user_id, min(ts) as start, count(*)::bigint as n from s group by user_id, sid""")
def session_windows(spark, sf):
    """Extension: sessions that end after six hours of silence."""
    return ep.event_steps(_events(spark, sf)).groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query(f"""with {_EV} select event_id, case event_type when 'view' then 'open' when 'click' then case when k < 50 then 'option' else 'paginate' end when 'purchase' then 'buy'
when 'error' then case when k % 2 = 0 then 'invalid' else 'repair' end else 'search' end as label from ev""")
def action_labels(spark, sf):
    t, k = F.col("event_type"), F.col("k")
    label = F.when(t == "view", "open").when(t == "click", F.when(k < 50, "option").otherwise("paginate")).when(t == "purchase", "buy").when(t == "error", F.when(k % 2 == 0, "invalid").otherwise("repair")).otherwise("search")
    return ep.event_steps(_events(spark, sf)).select("event_id", label.alias("label"))


@query("""select event_id, (event_id + 1) % 10 = 0 as saves, (event_id // 2)::bigint as rollout_step from events""")
def periodic_flags(spark, sf):
    return _events(spark, sf).select("event_id", ((F.col("event_id") + 1) % 10 == 0).alias("saves"), F.expr("event_id div 2").alias("rollout_step"))


@query(f"""with {_EV}, u as (select event_id // 2 as step, avg(value) as loss from ev where event_type = 'click' group by 1),
r as (select event_id as step, k from ev where event_type = 'view') select r.step, r.k, round(u.loss, 6) as loss from r join u on u.step = r.step""")
def two_clock_join(spark, sf):
    e = ep.event_steps(_events(spark, sf))
    u = e.where("event_type = 'click'").groupBy(F.expr("event_id div 2").alias("step")).agg(r6(F.avg("value")).alias("loss"))
    return e.where("event_type = 'view'").select(F.col("event_id").alias("step"), "k").join(u, "step")


@query(f"""with {_EV}, s as (select user_id, k, ts, event_id, row_number() over (partition by user_id, k order by ts, event_id) as n from ev where event_type = 'view'),
e as (select user_id, k, ts, event_id, row_number() over (partition by user_id, k order by ts, event_id) as n from ev where event_type = 'click')
select s.event_id as start_id, e.event_id as end_id, case when s.event_id is null then 'orphan' when e.event_id is null then 'open' when e.ts < s.ts then 'crossed' else 'closed' end as state
from s full join e on s.user_id = e.user_id and s.k = e.k and s.n = e.n""")
def span_pairing(spark, sf):
    """Starts and ends by id; orphans and open spans are kept."""
    w = Window.partitionBy("user_id", "k").orderBy(*ORDER)
    side = lambda t, p: ep.event_steps(_events(spark, sf)).where(F.col("event_type") == t).select("user_id", "k", F.row_number().over(w).alias("n"), F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"))
    s = side("view", "start").join(side("click", "end"), ["user_id", "k", "n"], "full")
    state = F.when(F.col("start_id").isNull(), "orphan").when(F.col("end_id").isNull(), "open").when(F.col("end_ts") < F.col("start_ts"), "crossed").otherwise("closed")
    return s.select("start_id", "end_id", state.alias("state"))


@query(f"""with {_EV} select event_id, least(ts + interval 2 hour, coalesce(lead(ts) over (partition by user_id, event_type order by ts, event_id), ts + interval 2 hour)) as clipped_end from ev""")
def next_sibling_clip(spark, sf):
    """An open span ends at its next sibling's start, at the latest."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy(*ORDER))
    limit = F.col("ts") + F.expr("interval 2 hours")
    return ep.event_steps(_events(spark, sf)).select("event_id", F.least(limit, F.coalesce(nxt, limit)).alias("clipped_end"))


@query(f"""with {_EV}, a as (select event_type, list_sort(list(value)) as l, avg(value) as m from ev group by 1)
select event_type, round(m, 6) as mean_value, l[round_even((len(l) - 1) * 0.95, 0)::int + 1] as p95 from a""")
def replay_summary(spark, sf):
    """Mean and nearest-rank p95; the value lists are of one type each, so the ranks come from counts, not lists."""
    e = ep.event_steps(_events(spark, sf))
    # Nearest rank by counting: values by type are counted, and running counts find the rank.
    counts = e.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type").orderBy("value")
    counts = counts.withColumn("upto", F.sum("c").over(w))
    total = e.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))
    rank = F.bround((F.col("n") - 1) * 0.95) + 1
    return counts.join(total, "event_type").where(F.col("upto") >= rank).groupBy("event_type").agg(F.first("mean_value").alias("mean_value"), F.min("value").alias("p95"))


@query(f"""with {_EV} select event_type, count(*)::bigint as calls, round(sum(value), 4) as seconds, round(count(*) / sum(value), 6) as per_second, max(k) as largest from ev where k >= 10 group by 1""")
def request_attr_stats(spark, sf):
    e = ep.event_steps(_events(spark, sf)).where("k >= 10")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("seconds"), r6(ratio(F.count("*"), F.sum("value"))).alias("per_second"), F.max("k").alias("largest"))


@query(f"""with {_EV} select event_type, count(*)::bigint as n, round(count(*) / sum(count(*)) over (), 6) as share from ev group by 1""")
def category_share(spark, sf):
    c = _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return c.withColumn("share", r6(ratio("n", F.sum("n").over(Window.partitionBy()))))


@query(f"""with {_EV} select day, round(avg(value), 6) as mean_value, max(value) as max_value, count(*) filter (event_type = 'error')::bigint as zero_steps,
list_sort(list(k) filter (event_type = 'error' and k < 5)) as zero_list from ev group by 1""")
def round_stats_with_list(spark, sf):
    """Per-day figures with the short list of exceptional updates."""
    odd = F.collect_list(F.when((F.col("event_type") == "error") & (F.col("k") < 5), F.col("k")))
    d = ep.event_steps(_events(spark, sf)).groupBy("day").agg(r6(F.avg("value")).alias("mean_value"), F.max("value").alias("max_value"), F.count_if(F.col("event_type") == "error").alias("zero_steps"), F.sort_array(odd).alias("zero_list"))
    return d.withColumn("zero_list", F.when(F.size("zero_list") > 0, F.col("zero_list")))


@query(f"""with {_EV}, n as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 3 as step from ev)
select user_id, step::bigint as step, min(event_id) as first_event, round(sum(value), 4) as total from n group by 1, 2 having count(*) = 3""")
def three_event_steps(spark, sf):
    """Every three events are a step; an incomplete tail is dropped."""
    n = ep.event_steps(_events(spark, sf)).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)))
    g = n.groupBy("user_id", F.expr("cast((i - 1) div 3 as bigint)").alias("step")).agg(F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("c"))
    return g.where("c = 3").drop("c")


@query(f"""with {_EV}, n as (select *, row_number() over (partition by user_id order by ts, event_id) as a from ev),
b as (select *, a - row_number() over (partition by user_id order by ts, event_id) as run from n where event_type in ('error', 'signup'))
select user_id, min(ts) as first_at, max(ts) as last_at, count(*)::bigint as length from b group by user_id, run having count(*) >= 2""")
def failure_streaks(spark, sf):
    return ep.streaks(ep.event_steps(_events(spark, sf)), F.col("event_type").isin("error", "signup"), ["user_id"], ORDER).where("length >= 2")


@query(f"""with {_EV}, g as (select user_id, max(ts) as newest, count(*)::bigint as n from ev group by 1) select * from g order by newest desc, user_id limit 10""")
def newest_groups(spark, sf):
    """The ten groups with the newest member: a top-k report."""
    g = _events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("newest"), F.count("*").alias("n"))
    return g.orderBy(F.desc("newest"), "user_id").limit(10)


@query(f"""with {_EV}, f as (select * from ev where event_type = 'purchase' order by ts, event_id limit 32) select event_id, user_id, row_number() over (order by event_id) as pos from f""")
def first_n_arrivals(spark, sf):
    """The first 32 to arrive, put back into the order of their number."""
    f = _events(spark, sf).where("event_type = 'purchase'").orderBy("ts", "event_id").limit(32)
    return f.select("event_id", "user_id", F.row_number().over(Window.orderBy("event_id")).cast("bigint").alias("pos"))


@query(f"""with {_EV}, d as (select *, date_diff('microsecond', lag(ts) over (partition by user_id, day order by ts, event_id), ts) / 1e6 as dt from ev)
select event_id, round(coalesce(sum(greatest(dt, 0)) over (partition by user_id, day order by ts, event_id), 0), 6) as phase_offset from d""")
def running_phase_offsets(spark, sf):
    """Running sums of positive durations within a phase."""
    w = ep.episode_window(KEY, ORDER)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    d = ep.event_steps(_events(spark, sf)).withColumn("dt", (us(F.col("ts")) - us(F.lag("ts").over(w))) / 1e6)
    return d.select("event_id", r6(F.coalesce(F.sum(F.greatest("dt", F.lit(0.0))).over(w), F.lit(0.0))).alias("phase_offset"))


@query(f"""with {_EP} select user_id, day, outcome, steps >= 2 as completed, case when outcome = 'technical' then null else outcome = 'success' end as scored from ep""")
def typed_rollup_reload(spark, sf):
    e = ep.event_episodes(_events(spark, sf))
    return e.select("user_id", "day", "outcome", (F.col("steps") >= 2).alias("completed"), F.when(F.col("outcome") != "technical", F.col("outcome") == "success").alias("scored"))


@query("""with bad as (select event_id, case when event_id % 7 = 0 then substr(props, 1, 3) when event_id % 11 = 0 then '' else props end as line from events)
select event_id, try_cast(json_extract_string(case when json_valid(line) then line end, '$.k') as int) as k from bad where json_valid(line)""")
def json_lenient_scan(spark, sf):
    """Bad lines are skipped, not raised."""
    line = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).when(F.col("event_id") % 11 == 0, "").otherwise(F.col("props"))
    v = F.try_parse_json("line")
    return _events(spark, sf).select("event_id", line.alias("line")).where(v.isNotNull()).select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"))


@query(f"""with {_EV} select user_id, k, event_id from ev where event_type = 'view' and value > 5 qualify row_number() over (partition by user_id, k order by ts desc, event_id desc) = 1""")
def keyed_cache_scan(spark, sf):
    """Rows of one provenance; the last of each key holds."""
    rows = ep.event_steps(_events(spark, sf)).where("event_type = 'view' and value > 5").select("user_id", "k", "ts", "event_id")
    return ep.latest_record(rows, ["user_id", "k"], ORDER).select("user_id", "k", "event_id")
