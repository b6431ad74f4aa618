"""Catalog rows: exclusion, ids, price resolution, options, reward, goals; and fixed-size work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.common import global_rank, ratio


def price_axes(df: DataFrame, product: str, axis: str, price: str) -> DataFrame:
    """Axes per product on which the price differs; more than one excludes the product, with a reason."""
    axes = df.groupBy(product, axis).agg((F.countDistinct(price) > 1).alias("varies"))
    n = axes.groupBy(product).agg(F.count_if("varies").alias("varying_axes"))
    return n.withColumn("reason", F.when(F.col("varying_axes") > 1, "several_price_axes"))


def first_seen(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by a partial aggregate; null keys are left out."""
    rest = F.struct(*df.columns)
    best = df.withColumn("_k", key).where("_k is not null").groupBy("_k").agg(F.min_by(rest, F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def category_parts(path: Column) -> Column:
    """Lower-case parts of a path cut at > / or a backslash."""
    return F.filter(F.transform(F.split(F.lower(path), r"[›>/\\]"), lambda x: F.trim(x)), lambda x: x != "")


def type_score(shared: Column, title: Column) -> Column:
    """1 for two shared path parts or a title overlap above 0.2; 0 for none; 0.1 under 0.1; else 0.5."""
    return F.when((shared >= 2) | (title > 0.2), 1.0).when(title == 0, 0.0).when(title < 0.1, 0.1).otherwise(0.5)


def fraction(found: Column, wanted: Column) -> Column:
    """Share of wanted values among the found ones; 1 if none is wanted."""
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, found)) / F.size(wanted))


def price_score(price: Column, ceiling: Column) -> Column:
    """1 without a ceiling, 0 if the price can't be verified, else whether it fits."""
    return F.when(ceiling.isNull(), 1.0).when(price.isNull(), 0.0).otherwise((price <= ceiling).cast("double"))


def loose_reward(kind: Column, found: Column, wanted: Column, options: Column, wanted_options: Column, price: Column) -> Column:
    """type * (attributes met + options met + price) / (attributes + options + 1)."""
    met = F.size(F.array_intersect(wanted, found)) + F.size(F.array_intersect(wanted_options, options))
    return kind * (met + price) / (F.size(wanted) + F.size(wanted_options) + 1)


def option_state(chosen: Column, offered: Column) -> Column:
    """struct(valid, missing, invalid) of a map axis -> value against a map axis -> array of values."""
    ok = F.map_filter(chosen, lambda k, v: F.coalesce(F.array_contains(F.try_element_at(offered, k), v), F.lit(False)))
    return F.struct(
        F.array_sort(F.map_keys(ok)).alias("valid"),
        F.array_sort(F.array_except(F.map_keys(offered), F.map_keys(chosen))).alias("missing"),
        F.array_sort(F.array_except(F.map_keys(chosen), F.map_keys(ok))).alias("invalid"),
    )


def resolved_price(listed: Column, option_price: Column, base: Column) -> Column:
    """The option's price, else the first listed, else the base, else 100."""
    return F.coalesce(option_price, F.try_element_at(listed, F.lit(1)), base, F.lit(100.0))


def epoch_order(df: DataFrame, key: str, seed: str, epoch: int) -> DataFrame:
    """shuffle_key: the order of an epoch, by hash."""
    return df.withColumn("shuffle_key", F.sha2(F.concat_ws(":", F.lit(seed), F.lit(str(epoch)), F.col(key).cast("string")), 256))


def unused_numbers(df: DataFrame, number: str, key: str) -> DataFrame:
    """Fills null numbers with the smallest unused non-negative ones, in key order.

    The unused numbers needed are below (rows + missing), so the candidates are a range
    that grows with the missing rows only as far as used numbers leave holes.
    """
    missing = df.where(F.col(number).isNull()).select(key)
    m = missing.count()
    used = df.where(F.col(number).isNotNull()).select(F.col(number).alias("_n")).distinct()
    top = m + used.where(F.col("_n") < df.count()).count()
    free = df.sparkSession.range(top).select(F.col("id").alias("_n")).join(used, "_n", "left_anti")
    free = global_rank(free, "_n").select("_n", F.col("rank_no").alias("_i")).where(F.col("_i") <= m)
    wanted = global_rank(missing, key).select(key, F.col("rank_no").alias("_i"))
    given = wanted.join(free, "_i").select(key, "_n")
    return df.join(given, key, "left").withColumn(number, F.coalesce(number, "_n")).drop("_n")
