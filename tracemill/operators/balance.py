"""Sequences into micro-batches and ranks: first fit, splitting, differencing, greedy, schedules.

These place items one after another, so they run in Python on one step's items at a
time (``applyInPandas`` by step). A step's size is a training parameter, which bounds
the group. Ties always go to the smaller index.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item in input order: the first open bin with room; an oversized item has its own."""
    room: list[int] = []
    out = []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), None)
        if at is None:
            at = len(room)
            room.append(capacity)
        room[at] -= s
        out.append(at)
    return out


def split_to(bins: list[list[int]], sizes: list[int], target: int) -> list[list[int]]:
    """Splits the heaviest bin of several items into two balanced halves until there are ``target`` bins, if that can be."""
    bins = [list(b) for b in bins]
    while len(bins) < target:
        many = [i for i, b in enumerate(bins) if len(b) > 1]
        if not many:
            break
        at = max(many, key=lambda i: (sum(sizes[j] for j in bins[i]), -i))
        halves, weight = ([], []), [0, 0]
        for j in sorted(bins[at], key=lambda j: (-sizes[j], j)):
            side = int(weight[1] < weight[0] or (weight[0] == weight[1] and len(halves[1]) < len(halves[0])))
            halves[side].append(j)
            weight[side] += sizes[j]
        bins[at : at + 1] = [sorted(h) for h in halves]
    return bins


def differencing(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """k parts of nearly equal sums by the largest-differencing method.

    The two tuples of parts with the widest spread are combined, heaviest against
    lightest, until one is left. With ``equal`` all parts have the same number of items,
    which must divide.
    """
    if equal and len(sizes) % k:
        raise ValueError("the items do not divide into equal parts")
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if equal:
        start = [[(sizes[i], [i]) for i in order[at : at + k]] for at in range(0, len(order), k)]
    else:
        start = [[(0, [])] * (k - 1) + [(sizes[i], [i])] for i in order]
    heap = []
    for n, parts in enumerate(start):
        parts = sorted(parts, key=lambda p: -p[0])
        heap.append((-(parts[0][0] - parts[-1][0]), n, parts))
    heapq.heapify(heap)
    n = len(start)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        heapq.heappush(heap, (-(both[0][0] - both[-1][0]), n, both))
        n += 1
    return [sorted(p[1]) for p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(sizes: list[int], k: int) -> list[list[int]]:
    """Each item, largest first, goes to the lightest part."""
    heap, parts = [(0, i) for i in range(k)], [[] for _ in range(k)]
    for j in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        w, i = heapq.heappop(heap)
        parts[i].append(j)
        heapq.heappush(heap, (w + sizes[j], i))
    return [sorted(p) for p in parts]


def byte_chunks(sizes: list[int], limit: int) -> list[int]:
    """Chunk of each item; a chunk closes when its sum reaches the limit."""
    out, chunk, total = [], 0, 0
    for s in sizes:
        out.append(chunk)
        total += s
        if total >= limit:
            chunk, total = chunk + 1, 0
    return out


def schedule_step(sizes: list[int], ranks: int, capacity: int) -> list[tuple[int, int]]:
    """(rank, micro-batch) of each item of a step.

    Items fill micro-batches by first fit, the number of which is raised to a multiple of
    the ranks by splitting; micro-batches then go to ranks by differencing with equal counts.
    """
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(first_fit(sizes, capacity)):
        bins.setdefault(b, []).append(i)
    want = -(-max(len(bins), 1) // ranks) * ranks
    batches = split_to(list(bins.values()), sizes, want)
    batches += [[] for _ in range(want - len(batches))]
    out = [(0, 0)] * len(sizes)
    for rank, part in enumerate(differencing([sum(sizes[i] for i in b) for b in batches], ranks, equal=True)):
        for m, b in enumerate(part):
            for i in batches[b]:
                out[i] = (rank, m)
    return out


def _by_step(df: DataFrame, step: str, order: str, size: str, f, columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(",")]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "s"], kind="stable")
        got = f([int(x) for x in rows["s"]])
        out = pd.DataFrame(got, columns=names, index=rows.index) if got and isinstance(got[0], tuple) else pd.DataFrame({names[0]: got}, index=rows.index)
        return pd.concat([rows[["k", "o"]], out], axis=1)

    rows = df.select(F.col(step).cast("bigint").alias("k"), F.col(order).cast("bigint").alias("o"), F.col(size).cast("bigint").alias("s")).where("s is not null and s >= 0")
    return rows.groupBy("k").applyInPandas(run, f"k bigint, o bigint, {columns}").withColumnRenamed("k", step).withColumnRenamed("o", order)


def pack_steps(df: DataFrame, step: str, order: str, size: str, capacity: int) -> DataFrame:
    """step, order, bin_no by first fit."""
    return _by_step(df, step, order, size, lambda s: first_fit(s, capacity), "bin_no int")


def schedule(df: DataFrame, step: str, order: str, size: str, ranks: int, capacity: int) -> DataFrame:
    """step, order, rank_no, batch_no."""
    return _by_step(df, step, order, size, lambda s: schedule_step(s, ranks, capacity), "rank_no int, batch_no int")


def chunk_steps(df: DataFrame, step: str, order: str, size: str, limit: int) -> DataFrame:
    """step, order, chunk_no by cumulative size."""
    return _by_step(df, step, order, size, lambda s: byte_chunks(s, limit), "chunk_no int")
