"""Episodes of events: order, state before an action, revisits, roll-ups, streaks, spans.

An episode is any group of columns; steps are ordered by a unique order. All
windows partition by the episode, whose length bounds a task's sorted rows; the
windows stream and spill. Nulls: a null value never counts as a visit or an option.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.common import ratio


def event_steps(events: DataFrame) -> DataFrame:
    """events with day and k: an episode is (user_id, day)."""
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def episode_window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def state_before(df: DataFrame, state: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The last non-null ``state`` of the steps before."""
    return df.withColumn(name, F.last(state, ignorenulls=True).over(episode_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)))


def revisit_flags(df: DataFrame, what: str, keys: list[str], order: list[str], name: str = "revisit") -> DataFrame:
    """1 where ``what`` was already visited in the episode; null visits are 0."""
    n = F.row_number().over(episode_window([*keys, what], order))
    return df.withColumn(name, F.when(F.col(what).isNotNull() & (n > 1), 1).otherwise(0))


def option_changes(df: DataFrame, axis: str, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """1 where the value on an axis differs from the one chosen before on it."""
    before = F.lag(value).over(episode_window([*keys, axis], order))
    return df.withColumn("changed", F.when(before.isNotNull() & (before != F.col(value)), 1).otherwise(0))


def outcome(any_good: Column, all_bad: Column) -> Column:
    """technical if every step is bad, else success or failure."""
    return F.when(all_bad, "technical").when(any_good, "success").otherwise("failure")


def event_episodes(events: DataFrame) -> DataFrame:
    """A row for each (user_id, day) of event_steps, with counts and the outcome.

    A technical episode has no reward; it is neither success nor failure.
    """
    steps = revisit_flags(event_steps(events), "k", ["user_id", "day"], ["ts", "event_id"])
    is_type = lambda t: F.sum((F.col("event_type") == t).cast("int"))
    rows = steps.groupBy("user_id", "day").agg(
        F.count("*").alias("steps"), is_type("error").alias("errors"), is_type("purchase").alias("purchases"), F.countDistinct("k").alias("products"),
        F.sum("revisit").alias("revisits"), F.sum("value").alias("value"), F.min("ts").alias("started"),
    )
    rows = rows.withColumn("outcome", outcome(F.col("purchases") > 0, F.col("errors") == F.col("steps")))
    return rows.withColumn("reward", F.when(F.col("outcome") == "success", 1.0).when(F.col("outcome") == "failure", 0.0))


def streaks(df: DataFrame, bad: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Runs of bad steps: keys, first and last order value, length (gaps and islands)."""
    w = episode_window(keys, order)
    marked = df.withColumn("_bad", bad).withColumn("_all", F.row_number().over(w))
    only = marked.where("_bad")
    only = only.withColumn("_run", F.col("_all") - F.row_number().over(w))
    first, last = F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at")
    return only.groupBy(*keys, "_run").agg(first, last, F.count("*").alias("length")).drop("_run")


def latest_record(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key with its number of attempts, by one partial aggregate."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count("*").alias("attempts"))
    return best.select(*key, *(F.col("_r")[c].alias(c) for c in rest), "attempts")


def after_complete(df: DataFrame, done: Column, key: list[str], order: list[str]) -> DataFrame:
    """Attempts recorded after the key was already complete."""
    w = episode_window(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_done", F.max(done.cast("int")).over(w)).where("_done = 1").drop("_done")


def interval_union(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merged intervals per key; touching intervals merge. Rows with a null end or start are left out."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_island")


def gaps(merged: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Gaps between neighbouring merged intervals."""
    w = Window.partitionBy(*keys).orderBy(start)
    rows = merged.select(*keys, F.col(end).alias("gap_start"), F.lead(start).over(w).alias("gap_end"))
    return rows.where("gap_end > gap_start")


def describe(df: DataFrame, by: list[str], metrics: list[str], distinct: str, flag: Column) -> DataFrame:
    """n, distinct ids, success rate, and mean, median, p90 of each metric; nulls stay out of every figure."""
    aggs = [F.count("*").alias("n"), F.countDistinct(distinct).alias("ids"), F.round(F.avg(flag), 6).alias("success_rate")]
    for m in metrics:
        c = F.col(m).cast("double")
        p = F.percentile(c, F.array(F.lit(0.5), F.lit(0.9)))
        aggs += [F.round(F.avg(c), 6).alias(f"{m}_mean"), F.round(p[0], 6).alias(f"{m}_median"), F.round(p[1], 6).alias(f"{m}_p90")]
    return df.groupBy(*by).agg(*aggs)


def pooled_and_mean(df: DataFrame, by: list[str], top: str, bottom: str) -> DataFrame:
    """Ratio of sums beside the mean of ratios; rows without both parts leave both denominators."""
    ok = F.col(top).isNotNull() & F.col(bottom).isNotNull()
    rows = df.where(ok)
    return rows.groupBy(*by).agg(F.round(ratio(F.sum(top), F.sum(bottom)), 6).alias("pooled"), F.round(F.avg(ratio(top, bottom)), 6).alias("mean_ratio"))


def discounted_returns(rewards: Column, gamma: float) -> Column:
    """Return-to-go of each step of a reward array, by one fold from the end."""
    fold = F.aggregate(F.reverse(rewards), F.array().cast("array<double>"), lambda acc, r: F.array_prepend(acc, r.cast("double") + gamma * F.coalesce(F.try_element_at(acc, F.lit(1)), F.lit(0.0))))
    return fold


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages; the value after the last step is 0."""
    after = F.concat(F.slice(values, 2, F.size(values)), F.array(F.lit(0.0)))
    deltas = F.zip_with(F.zip_with(rewards, after, lambda r, v: r + gamma * v), values, lambda a, v: a - v)
    return discounted_returns(deltas, gamma * lam)
