"""Linked rows: connected components over shared keys, and splits that keep them whole.

Edges go from every row to the least row of each key, so that a key shared by a
third of all rows costs one edge a row. Labels fall by rounds of neighbour minimum
and pointer jumping; state is checkpointed each round in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import checkpointed, written


def components(links: DataFrame, row: str, key: str) -> DataFrame:
    """row, component: the least row of its component. ``links`` has a row for each (row, key); null keys link nothing."""
    rows = links.select(F.col(row).alias("r")).where("r is not null").distinct()
    ok = links.select(F.col(row).alias("r"), F.col(key).alias("k")).where("r is not null and k is not null")
    least = ok.groupBy("k").agg(F.min("r").alias("hub"))
    star = ok.join(least, "k").where("r <> hub").select(F.col("r").alias("a"), F.col("hub").alias("b")).distinct()
    edges = written(star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = checkpointed(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near, "a").select("a", "label", F.least("label", "low").alias("low"))
        jump = step.select(F.col("a").alias("t"), F.col("low").alias("far"))
        new = step.join(jump, F.col("low") == F.col("t"), "left").select("a", F.col("label").alias("old"), F.least("low", F.coalesce("far", "low")).alias("label"))
        new = checkpointed(new)
        labels = new.select("a", "label")
        if new.where("old <> label").isEmpty():
            break
    return rows.join(labels, F.col("r") == F.col("a"), "left").select(F.col("r").alias(row), F.coalesce("label", "r").alias("component"))


def subset_of_sizes(counts: dict[int, int], target: int) -> dict[int, int] | None:
    """How many groups of each size add up to the target exactly, or None.

    Reachable sums as bits of one integer; each size is tried with its count in powers of
    two. The input is a histogram, bounded by the distinct sizes, not by the groups.
    """
    items = []
    for size in sorted(counts, reverse=True):
        n, p = counts[size], 1
        while n > 0:
            items.append((size, min(p, n)))
            n, p = n - min(p, n), p * 2
    mask, reach = (1 << (target + 1)) - 1, [1]
    for size, times in items:
        reach.append((reach[-1] | reach[-1] << (size * times)) & mask)
    if not reach[-1] >> target & 1:
        return None
    out: dict[int, int] = {}
    for i in range(len(items), 0, -1):
        if not reach[i - 1] >> target & 1:
            size, times = items[i - 1]
            out[size] = out.get(size, 0) + times
            target -= size * times
    return out


def whole_group_split(groups: DataFrame, target: int, seed: str, name: str) -> DataFrame:
    """component, split: groups whose sizes add up to ``target`` exactly go to ``name``, the others to 'rest'.

    Among groups of one size the first by hash are taken. Without an exact sum a
    ValueError is raised.
    """
    counts = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()}
    take = subset_of_sizes(counts, target)
    if take is None:
        raise ValueError(f"no groups add up to {target}")
    spark = groups.sparkSession
    quota = spark.createDataFrame(list(take.items()) or [(0, 0)], "size long, quota int")
    w = Window.partitionBy("size").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col("component").cast("string")), 256))
    ranked = groups.withColumn("_r", F.row_number().over(w)).join(quota, "size", "left")
    return ranked.select("component", "size", F.when(F.col("_r") <= F.coalesce("quota", F.lit(0)), name).otherwise("rest").alias("split"))


def split_tasks(groups: DataFrame, row: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """row, component, split: one split after another takes whole components of exactly its size, the others are 'rest'.

    ``groups`` has (row, component). A size that no components add up to raises ValueError.
    """
    left = groups.groupBy("component").agg(F.count("*").alias("size"))
    left, parts = written(left, "components"), []
    for name, size in sizes.items():
        split = written(whole_group_split(left, size, f"{seed}:{name}", name), "split")
        parts.append(split.where(F.col("split") == name))
        left = split.where(F.col("split") == "rest").select("component", "size")
    out = left.withColumn("split", F.lit("rest"))
    for p in parts:
        out = out.unionByName(p)
    return groups.select(row, "component").join(out.select("component", "split"), "component")
