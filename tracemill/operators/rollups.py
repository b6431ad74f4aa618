"""Roll-ups of rollouts, groups, logs and buffers.

All are one or two partial aggregates; a group is never gathered into one list. Null
groups are groups of their own; empty inputs give no rows, or NULL where one row is asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.common import hash_uniform, ratio


def valid_groups(df: DataFrame, key: str, last: Column, least: int) -> DataFrame:
    """Groups with at least ``least`` members and as many with a last message that is not blank."""
    filled = F.count_if(F.coalesce(F.trim(last) != "", F.lit(False)))
    return df.groupBy(key).agg(F.count("*").alias("members"), filled.alias("filled")).where((F.col("members") >= least) & (F.col("filled") >= least))


def scored_groups(df: DataFrame, keys: list[str], reward: Column) -> DataFrame:
    """Per group its members, its scored ones and its correct ones (reward 1 or more)."""
    return df.groupBy(*keys).agg(F.count("*").alias("members"), F.count(reward).alias("scored"), F.count_if(reward >= 1).alias("correct"))


def group_rates(groups: DataFrame, by: str) -> DataFrame:
    """All-wrong rate over fully scored groups, and the share of groups that are dropped for missing scores."""
    full = F.col("scored") == F.col("members")
    return groups.groupBy(by).agg(
        F.count_if(full).alias("accepted"), F.count_if(~full).alias("dropped"), ratio(F.count_if(full & (F.col("correct") == 0)), F.count_if(full)).alias("all_wrong_rate"), ratio(F.count_if(~full), F.count("*")).alias("drop_rate")
    )


def common_names(df: DataFrame, by: str, row: str, names: Column) -> DataFrame:
    """Names that all rows of a group have; rows without names count."""
    rows = df.groupBy(by).agg(F.countDistinct(row).alias("rows"))
    each = df.select(by, row, F.explode(names).alias("name")).distinct().groupBy(by, "name").agg(F.count("*").alias("n"))
    return each.join(rows, by).where("n = rows").select(by, "name")


def solved_everywhere(df: DataFrame, task: str, round_: str, solved: Column) -> DataFrame:
    """Tasks that are solved in every round that tried them, and in how many; tasks of one round do not count."""
    by = df.groupBy(task, round_).agg(F.max(solved.cast("int")).alias("s"))
    return by.groupBy(task).agg(F.count("*").alias("rounds"), F.min("s").alias("least")).where("least = 1 and rounds > 1").select(task, "rounds")


def fifo_pop(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of a buffer with their place."""
    first = df.orderBy(*order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement, drawn by weight: the smallest exponential keys. Rows of weight 0 or NULL are never drawn."""
    draw = -F.log(1 - hash_uniform(F.lit(seed), F.col(key))) / weight
    return df.where(weight > 0).withColumn("draw", draw).orderBy("draw", key).limit(n)


def wrapped_batches(df: DataFrame, key: str, size: int, epochs: int, copies: int, seed: str) -> DataFrame:
    """batch_no, place, copy, sample_no, epoch: epochs in hash order, one after another, cut into batches that run on over their borders; each row ``copies`` times under dense numbers."""
    n = df.count()
    each = df.select(key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    w = Window.partitionBy("epoch", "_range").orderBy("_h", key)
    each = each.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col(key).cast("string")), 256)).withColumn("_range", F.substring("_h", 1, 2))
    starts = each.groupBy("epoch", "_range").agg(F.count("*").alias("_c"))  # 256 ranges an epoch
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.join(starts.select("epoch", "_range", before.alias("_b")), ["epoch", "_range"]).withColumn("_at", F.col("epoch") * n + F.col("_b") + F.row_number().over(w) - 1)
    out = placed.select(key, "epoch", F.expr(f"_at div {size}").alias("batch_no"), (F.col("_at") % size).alias("place"), "_at", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    return out.withColumn("sample_no", F.col("_at") * copies + F.col("copy")).drop("_at")


def log_rollup(df: DataFrame, rollout: str, per_rollout: list[str], per_sample: list[str], largest: list[str]) -> DataFrame:
    """metric, value: means over rollouts of their means, means over samples, and largest values, as each key asks."""
    by = df.groupBy(rollout).agg(*(F.avg(c).alias(c) for c in per_rollout)) if per_rollout else None
    one = [F.avg(c).alias(c) for c in per_sample] + [F.max(c).cast("double").alias(c) for c in largest]
    long = lambda d, cs: d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in cs))).alias("m")).select("m.*")
    out = long(df.agg(*one), per_sample + largest)
    return out if by is None else out.unionByName(long(by.agg(*(F.avg(c).alias(c) for c in per_rollout)), per_rollout))


def timers(df: DataFrame, name: str, seconds: Column, work: Column) -> DataFrame:
    """Per timer its total, its laps and the work done a second."""
    return df.groupBy(name).agg(F.sum(seconds).alias("total"), F.count(seconds).alias("laps"), ratio(F.sum(work), F.sum(seconds)).alias("per_second"))


def completion_order(df: DataFrame, key: str, done_at: str, aborted: Column, tie: str) -> DataFrame:
    """Per key the arrivals as a worker hands them out: by completion, aborted ones re-queued behind all others with their round."""
    w = Window.partitionBy(key).orderBy("requeued", F.col(done_at).asc_nulls_last(), tie)
    return df.withColumn("requeued", aborted.cast("int")).withColumn("place", F.row_number().over(w))


def assembled(df: DataFrame, key: str, index: str, delta: Column, finish: Column) -> DataFrame:
    """A response from its deltas: text in the order of their index, its parts, and the finish reason of the last part that has one.

    The parts of one response are bounded by the response; null deltas add nothing.
    """
    parts = F.array_sort(F.collect_list(F.when(delta.isNotNull(), F.struct(F.col(index).alias("i"), delta.alias("d")))))
    return df.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["d"]), "").alias("text"), F.count(delta).alias("parts"), F.max_by(F.when(finish.isNotNull(), finish), F.when(finish.isNotNull(), F.col(index))).alias("finish_reason")
    )
