"""Paired comparisons, hash-deterministic treatments, no-intercept regression, selection.

Pairing averages siblings first, so a task counts once. Regressions aggregate the
Gram entries in one pass; only k x k numbers reach the driver. Ties always end in an
explicit order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.common import clipped, hash_bits, hash_number, hash_uniform, sorted_rank


def paired(df: DataFrame, arm: str, one, other, task: str, value: Column) -> DataFrame:
    """task, a, b, delta over tasks that have both arms; siblings are averaged, null values stay out."""
    per = df.where(F.col(arm).isin(one, other)).groupBy(task).agg(F.avg(F.when(F.col(arm) == one, value)).alias("a"), F.avg(F.when(F.col(arm) == other, value)).alias("b"))
    return per.where("a is not null and b is not null").withColumn("delta", F.col("a") - F.col("b"))


def key_sets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with their side: both, left or right."""
    l, r = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return l.join(r, keys, "full").select(*keys, side.alias("side"))


def gram(df: DataFrame, factors: list[str], outcome: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and the number of rows, by one aggregate; rows with nulls stay out."""
    ok = df.where(" and ".join(f"`{c}` is not null" for c in [*factors, outcome]))
    k = len(factors)
    x = [F.col(f).cast("double") for f in factors]
    aggs = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * F.col(outcome)).alias(f"m{i}") for i in range(k)]
    row = ok.agg(*aggs, F.count("*").alias("n")).first()
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], dtype=float)
    return g, np.array([row[f"m{i}"] or 0.0 for i in range(k)], dtype=float), row["n"]


def solve(g: np.ndarray, m: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Elimination with row exchange; raises ValueError where a pivot is too small against the matrix."""
    a, n = np.column_stack([g, m]).astype(float), len(m)
    limit = tolerance * max(1.0, float(np.abs(g).max(initial=0.0)))
    for i in range(n):
        p = i + int(np.argmax(np.abs(a[i:, i])))
        if abs(a[p, i]) <= limit:
            raise ValueError("the design is singular")
        a[[i, p]] = a[[p, i]]
        a[i] /= a[i, i]
        for j in range(n):
            if j != i:
                a[j] -= a[j, i] * a[i]
    return np.where(np.abs(a[:, -1]) <= tolerance, 0.0, a[:, -1])


def ols_no_intercept(df: DataFrame, factors: list[str], outcome: str) -> DataFrame:
    """factor, coefficient, rows."""
    g, m, n = gram(df, factors, outcome)
    beta = solve(g, m)
    return df.sparkSession.createDataFrame([(f, float(b), int(n)) for f, b in zip(factors, beta, strict=True)], "factor string, coefficient double, n bigint")


def bernoulli(*parts: Column) -> Column:
    """1 with probability one half, by hash."""
    return (hash_bits(*parts) < "8000000000000000").cast("int")


def slot_of(n: int, *parts: Column) -> Column:
    """A version from 0 (absent) to n, by hash."""
    return (hash_number(*parts) % F.lit(n + 1)).cast("int")


def inclusion_probability(df: DataFrame, effect: str, low: float = 0.1, high: float = 0.9) -> Column:
    """Clipped linear in the effect; the scale is ``df``'s largest positive effect, one scalar aggregate."""
    top = df.agg(F.max(F.when(F.col(effect) > 0, F.col(effect)))).scalar()
    return F.when(top.isNull(), F.lit(low)).otherwise(clipped(F.lit(low) + F.lit(high - low) * F.col(effect) / top, low, high))


def group_treatment(groups: DataFrame, chunks: DataFrame, key: str, seed: str, free: float) -> DataFrame:
    """key, mode, ids: a group is free of skills, or each chunk is drawn by its own probability.

    ``chunks`` (chunk_id, probability) is the experiment's frozen list; every group draws for each
    of its chunks, so the pairs are the operator's own.
    """
    g = groups.select(key).distinct().withColumn("_free", hash_uniform(F.lit(seed), F.col(key), F.lit("free")) < free)
    each = g.join(chunks, ~F.col("_free") & (hash_uniform(F.lit(seed), F.col(key), F.col("chunk_id")) < F.col("probability")), "left")
    out = each.groupBy(key).agg(F.first("_free").alias("_free"), F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    return out.select(key, F.when(F.col("_free"), "free").when(F.size("ids") == 0, "empty").otherwise("assisted").alias("mode"), "ids")


def family_winners(df: DataFrame, family: str, effect: str, old: Column, tie: str) -> DataFrame:
    """The best version of each family; the old version wins ties, then the smallest id."""
    w = Window.partitionBy(family).orderBy(F.desc(effect), F.desc(old.cast("int")), tie)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_positive(df: DataFrame, effect: str, tie: str, k: int) -> DataFrame:
    """effect_rank, and status selected (rank up to k), reserve or rejected (effect not above 0)."""
    ranked = sorted_rank(df, -F.col(effect), tie).withColumnRenamed("rank_no", "effect_rank")
    status = F.when(F.col(effect) <= 0, "rejected").when(F.col("effect_rank") <= k, "selected").otherwise("reserve")
    return ranked.withColumn("status", status)


def bootstrap_interval(deltas: DataFrame, metric: str, value: str, draws: int = 2000, seed: int = 11, level: float = 0.95) -> DataFrame:
    """metric, n, mean, low, high: percentile bootstrap of the mean difference.

    Resampling runs as Poisson weights by hash of (seed, row, draw), as partial sums:
    no metric's rows meet in one task. Each row's weights come from its own generator,
    so the result does not depend on the partitioning.
    """

    def sums(batches):
        for b in batches:
            out = {}
            for m, part in b.groupby("metric"):
                w = np.stack([np.random.default_rng([seed, int(r)]).poisson(1.0, draws) for r in part["row"]])
                out[m] = (w.sum(axis=0), part["value"].to_numpy() @ w, len(part), part["value"].sum())
            yield pd.DataFrame([(m, i, float(c[i]), float(s[i]), n, t) for m, (c, s, n, t) in out.items() for i in range(draws)], columns=["metric", "draw", "c", "s", "n", "t"])

    rows = deltas.select(F.col(metric).cast("string").alias("metric"), F.col(value).alias("value"), F.abs(F.xxhash64(*deltas.columns) % 2**40).alias("row")).where("value is not null")
    parts = rows.mapInPandas(sums, "metric string, draw int, c double, s double, n bigint, t double")
    means = parts.groupBy("metric", "draw").agg((F.sum("s") / F.sum("c")).alias("m"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    tail = (1 - level) / 2
    p = F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail)))
    return means.groupBy("metric").agg(F.max("n").alias("n"), (F.max("t") / F.max("n")).alias("mean"), p[0].alias("low"), p[1].alias("high"))


def refit(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """One row: beta_<feature>, rank. Least squares without an intercept; k x k sums reach the driver, and a singular design is told by its rank."""
    import numpy as np

    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = df.agg(*(F.sum(F.col(features[i]) * F.col(features[j])).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(F.col(f) * F.col(y)).alias(f"y{i}") for i, f in enumerate(features))).first()
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"] or 0.0
    beta, _, rank, _ = np.linalg.lstsq(gram, np.array([sums[f"y{i}"] or 0.0 for i in range(k)]), rcond=1e-12)
    return df.sparkSession.createDataFrame([(*map(float, beta), int(rank))], ", ".join([*(f"beta_{f} double" for f in features), "rank bigint"]))
