"""Small column builders shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, as results are compared."""
    return F.round(c, 6)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, NULL where b is 0 or NULL."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def sem(c: Column | str) -> Column:
    """Standard error of the mean; NULL under two values."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def finite(c: Column) -> Column:
    """NULL, NaN and infinities are not finite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def hash_bits(*parts: Column) -> Column:
    """The first 16 hex digits of a SHA-256 over parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 16)


def hash_number(*parts: Column) -> Column:
    """hash_bits as an unsigned integer; a long would overflow."""
    return F.conv(hash_bits(*parts), 16, 10).cast("decimal(20,0)")


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits, exact in a double."""
    return F.conv(F.substring(hash_bits(*parts), 1, 13), 16, 10).cast("double") / float(2**52)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum of the values where the mask is 1; 0 for an empty mask."""
    return F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m == 1, v.cast("double")).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def nearest_rank(values: Column, p: float) -> Column:
    """Element at the banker's-rounded index (n - 1) * p of the sorted values; NULL for none."""
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), F.bround((F.size(values) - 1) * F.lit(p)).cast("int") + 1))


def clipped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def global_rank(df: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """``df`` with ``rank_no``, the 1-based rank by a unique integer key: counts of key ranges give each range's start."""
    rows = df.withColumn("_range", F.floor(F.col(key) / width))
    starts = rows.groupBy("_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return rows.join(starts, "_range").withColumn("rank_no", F.col("_before") + inside).drop("_range", "_before")


def sorted_rank(df: DataFrame, order: Column, *ties: str, bins: int = 1024) -> DataFrame:
    """``df`` with ``rank_no``, the 1-based rank by a numeric ``order`` and then ``ties``.

    Equal cuts between the least and the largest value make ranges; counts of ranges give
    each range's start, and each range is sorted by itself. Null orders come last.
    """
    ends = df.agg(F.min(order).cast("double").alias("lo"), F.max(order).cast("double").alias("hi"))
    rows = df.withColumn("_o", order)
    cut = F.least(F.floor((F.col("_o").cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    rows = rows.crossJoin(ends).withColumn("_range", F.when(F.col("_o").isNull(), bins).when(F.col("hi") > F.col("lo"), cut).otherwise(0)).drop("lo", "hi")
    starts = rows.groupBy("_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_range", before.alias("_before"))  # at most bins + 1 rows
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_o", *ties))
    return rows.join(starts, "_range").withColumn("rank_no", F.col("_before") + inside).drop("_range", "_before", "_o")
