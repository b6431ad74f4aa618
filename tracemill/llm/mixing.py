"""Sources mixed to target shares of tokens.

Method: Efraimidis-Spirakis sampling. Every document gets the exponential key
-ln(u) / w from a hash u of its number and its quality weight w. A source's budget is
its share of the total. Whole epochs of the source come first: each takes every
document once. What is left of the budget is the fractional epoch: documents in the
order of their keys, as long as the prefix sum of tokens stays within the rest. So at most
one document's size is left unfilled, and short texts are not favoured at the edge.

Repeats: a source gives at most ``max_repeats`` epochs, and a document with no full
epoch behind it counts as used once in the fractional one. If a source can't fill its
share even so, its budget is cut to what it has and the shares reached are reported
as they are; with no total given, the total is the largest at which every source that
has any tokens reaches its share.

Scale: the prefix sum is not one window over a source. Keys are cut into ``BINS`` ranges
between a source's least and largest key, and sums of ranges tell in which of them the
budget ends; that range is cut again, until it holds at most ``RANGE_ROWS`` documents. Each
level is one partial aggregate, whatever the keys' distribution, and only the last range
is sorted.

Defined results: sources are compared without case, surrounding blanks and the
difference of blank, hyphen and underscore; documents without a source or with one
that has no target are not used; null and empty texts have no tokens and are not
used; targets with a null or non-positive share or no repeats are not used; rows without
a doc_id are not used, and rows of one doc_id and source are one document, with the
largest of their sizes. Equal keys are taken in the order of doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import written

#: Documents of the key range that is sorted.
RANGE_ROWS = 20_000
#: Key ranges of a level.
BINS = 1024


def source_name(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "")), r"[\s\-_]+", "_"), F.lit(""))


def quality_weight(text: Column) -> Column:
    """A weight from 0.25 to 2: long texts of varied characters weigh more.

    Length counts up to 2,000 characters; variety is the share of distinct characters
    in a window of 256, averaged over all the text's consecutive windows by their length.
    """
    length = F.least(F.length(text) / 2000.0, F.lit(1.0))
    windows = F.regexp_extract_all(text, F.lit("(?s)(.{1,256})"), F.lit(1))
    distinct = F.aggregate(windows, F.lit(0).cast("bigint"), lambda n, w: n + F.size(F.array_distinct(F.split(w, ""))))
    variety = distinct / F.greatest(F.length(text), F.lit(1))
    return F.lit(0.25) + length + F.lit(0.75) * F.least(variety, F.lit(1.0))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a SHA-256."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")), 256), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def _cut_ranges(items: DataFrame, plan: DataFrame) -> DataFrame:
    """source, lo, hi, before: the keys between which a source's rest ends, and the tokens of all keys below.

    Sources whose documents all fit have no row; sums below a range and in it tell where the rest ends.
    """
    ends = items.groupBy("source").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("tokens").alias("all"))
    at = written(plan.select("source", "rest").join(ends, "source").where("rest < all").select("source", "rest", "lo", "hi", F.lit(0).cast("bigint").alias("before")), "mixcut")
    while True:
        inside = items.join(at, "source").where("key between lo and hi")
        bin_no = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(0)
        bins = inside.groupBy("source", "rest", "before", bin_no.alias("bin_no")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        w = Window.partitionBy("source").orderBy("bin_no")  # at most BINS rows a source
        bins = bins.withColumn("upto", F.col("before") + F.sum("t").over(w))
        bins = bins.where("upto > rest and upto - t <= rest").select("source", "rest", "lo", "hi", (F.col("upto") - F.col("t")).alias("before"), "n")
        at = written(bins, "mixcut")
        if at.where((F.col("n") > RANGE_ROWS) & (F.col("hi") > F.col("lo"))).isEmpty():
            return at.select("source", "lo", "hi", "before")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(chosen: source, doc_id, tokens, repeats; report per target source).

    ``docs`` has doc_id, source, tokens, weight; ``targets`` source, target_share,
    max_repeats, one row a source.
    """
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    items = docs.select(F.col("doc_id"), source_name(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"), "weight").where("tokens > 0")
    items = items.join(goal.select("source"), "source", "left_semi")
    items = items.where("doc_id is not null").groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens"), F.max("weight").alias("weight"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.col("weight")
    items = written(items.withColumn("key", key), "mixitems")
    have = items.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    plan = goal.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    if total is None:
        # Shares of sources without tokens fall to the others, in proportion.
        live = F.when(F.col("available") > 0, F.col("target_share"))
        plan = plan.withColumn("_live", F.sum(live).over(Window.partitionBy()))
        size = F.min(F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") * F.col("_live") / F.col("target_share"))).over(Window.partitionBy())
        plan = plan.withColumn("budget", F.when(F.col("available") > 0, F.floor(size * F.col("target_share") / F.col("_live"))).otherwise(0).cast("bigint")).drop("_live")
    else:
        plan = plan.withColumn("budget", F.floor(F.lit(total) * F.col("target_share")).cast("bigint"))
    plan = plan.withColumn("budget", F.least("budget", F.col("available") * F.col("max_repeats")))
    plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(0))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    plan = written(plan, "mixplan")
    placed = items.join(plan.select("source", "epochs", "rest"), "source").join(_cut_ranges(items, plan), "source", "left")
    edge = placed.where("key between lo and hi")
    w = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("extra", (F.col("before") + F.sum("tokens").over(w) <= F.col("rest")).cast("int"))
    rest = placed.where("lo is null or key < lo or key > hi").withColumn("extra", F.when(F.col("lo").isNull() | (F.col("key") < F.col("lo")), 1).otherwise(0))
    # Where all fit, the rest is the whole source only if the budget ends with it.
    rest = rest.withColumn("extra", F.when(F.col("lo").isNull() & (F.col("rest") == 0), 0).otherwise(F.col("extra")))
    chosen = edge.unionByName(rest).select("source", "doc_id", "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("repeats")).where("repeats > 0")
    chosen = written(chosen, "mixchosen")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.count("*").alias("chosen"), F.max("repeats").alias("most_repeats"))
    out = plan.join(used, "source", "left").select("source", "target_share", "max_repeats", "available", "budget", F.coalesce("used", F.lit(0)).alias("used_tokens"), F.coalesce("chosen", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    whole = F.sum("used_tokens").over(Window.partitionBy())
    return chosen, out.withColumn("reached_share", F.round(F.try_divide(F.col("used_tokens").cast("double"), whole), 6))
