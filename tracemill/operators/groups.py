"""Groups of sibling rollouts: admission, normalisation, pass@k, triage.

A rollout may fan out into several rows; it counts once. Groups are aggregated
before anything is joined back, and the windows only hold one group's rollouts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.common import ratio

#: Smallest spread that counts as one.
EPS = 1e-6


def rollouts(df: DataFrame, group: list[str], rollout: str, reward: Column) -> DataFrame:
    """One row a rollout: siblings of a fan-out must agree, so their minimum is their value; nulls stay null."""
    return df.groupBy(*group, rollout).agg(F.min(reward).alias("reward"))


def advantages(r: DataFrame, group: list[str]) -> DataFrame:
    """(reward - mean) / (unbiased deviation + 1e-6) within the group; a lone rollout has 0."""
    w = Window.partitionBy(*group)
    return r.withColumn("advantage", (F.col("reward") - F.avg("reward").over(w)) / (F.coalesce(F.stddev_samp("reward").over(w), F.lit(0.0)) + EPS))


def admission(r: DataFrame, group: list[str]) -> DataFrame:
    """Per group: size, whether all are scored, spread, unbiased deviation, and keep."""
    g = r.groupBy(*group).agg(F.count("*").alias("size"), F.bool_and(F.col("reward").isNotNull()).alias("scored"), (F.max("reward") - F.min("reward")).alias("spread"), F.coalesce(F.stddev_samp("reward"), F.lit(0.0)).alias("deviation"))
    return g.withColumn("keep", F.col("scored") & (F.col("size") >= 2) & (F.col("spread") > EPS) & (F.col("deviation") > EPS))


def valid_zscore(r: DataFrame, group: list[str], low: float, high: float) -> DataFrame:
    """Population z-score of the rewards within [low, high]; others pass through.

    A group without valid rewards, or with no variance, keeps 0 for the valid ones.
    """
    w = Window.partitionBy(*group)
    v = F.when((F.col("reward") >= low) & (F.col("reward") <= high), F.col("reward"))
    mean, dev = F.avg(v).over(w), F.stddev_pop(v).over(w)
    return r.withColumn("z", F.when(v.isNull(), F.col("reward")).when(dev <= EPS, 0.0).otherwise((v - mean) / dev))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - prod(1 - k / i) for i from n - c + 1 to n; 0 for no correct one, 1 if fewer than k are wrong."""
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - prod)


def triage(n: Column, good: Column, scored: Column) -> Column:
    """Label of a group: incomplete, all_correct, all_wrong, mostly_correct or mixed."""
    return F.when(scored < n, "incomplete").when(good == n, "all_correct").when(good == 0, "all_wrong").when(good * 2 > n, "mostly_correct").otherwise("mixed")


def token_weighted_mean(df: DataFrame, rollout: list[str], x: str, mask: str) -> DataFrame:
    """Per rollout sum(x * mask) over its tokens, at least one token in the denominator."""
    return df.groupBy(*rollout).agg((F.sum(F.col(x) * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1))).alias("mean"))


def whitened(df: DataFrame, x: str, mask: str) -> DataFrame:
    """Global masked whitening: Bessel's variance from two masked rows, rsqrt(var + 1e-8)."""
    one = df.where(F.col(mask) == 1).agg(F.avg(x).alias("_m"), F.var_samp(x).alias("_v"))
    return df.crossJoin(F.broadcast(one)).withColumn("white", (F.col(x) - F.col("_m")) / F.sqrt(F.coalesce("_v", F.lit(0.0)) + 1e-8)).drop("_m", "_v")


def weighted_meta(meta: DataFrame, by: list[str], weight: str, columns: list[str]) -> DataFrame:
    """Sample-weighted averages over batches."""
    return meta.groupBy(*by).agg(F.sum(weight).alias(weight), *(F.round(ratio(F.sum(F.col(c) * F.col(weight)), F.sum(weight)), 6).alias(c) for c in columns))
