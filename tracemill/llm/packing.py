"""Documents into containers of a fixed number of tokens.

Method: sum-of-squares packing. Let N(g) be the number of open containers with gap
g. A piece goes where the sum over g of N(g) squared becomes smallest: into an open
container whose gap holds it, or into a new one. Full containers don't count.

A text longer than a container is cut at the container's size: its full parts fill
containers of their own and only the rest is packed; no other text is split.

The method places one piece after another, so the pieces are dealt into shards by
hash and each shard is packed alone. A shard holds about ``SHARD_TOKENS`` tokens
whatever the total, which bounds the group in a task; open containers that a shard
leaves are at most a few, so the loss shrinks with the shard's size. Hot sources or
copies are spread by the hash of the document's own number.

Defined results: null and empty texts have no pieces; rows without a doc_id are not
packed; rows of one doc_id are one document with the largest of their sizes; ties go
to the smallest gap, then to the container opened last.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of one shard, about.
SHARD_TOKENS = 4_000_000
#: Kinds of containers, a parameter table; more are an error.
MOST_KINDS = 1000
#: A default; path and pattern are parameters of every function that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's tokenizer cuts a text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY, pattern: str = PATTERN) -> int:
    """Tokens of the whole text."""
    return len(_encoding(path, pattern).encode_ordinary(text)) if text else 0


def token_count(text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Tokens of a column's whole texts. Spark sends the driver's vocabulary file to the executors."""
    SparkSession.active().sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf(T.IntegerType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = SparkFiles.get(name)
        for texts in batches:
            yield texts.map(lambda t: count_tokens(t, own, pattern)).astype("int32")

    return tokens(text)


class SumOfSquares:
    """One shard's open containers, by gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, offset) of a piece of 1 to capacity tokens."""
        c, n = self.capacity, self.count
        # Putting the piece into gap g takes N(g) down and N(g - size) up by one; gap 0 is full and not counted.
        gaps = np.flatnonzero(n[size:]) + size
        best, at = (2 * int(n[c - size]) + 1 if size < c else 0), c
        if len(gaps):
            left = gaps - size
            change = -2 * n[gaps] + 1 + np.where(left > 0, 2 * n[left] + 1, 0)
            i = int(np.argmin(change))
            if change[i] <= best:
                at = int(gaps[i])
        if at == c and not self.open.get(c):
            which, self.bins = self.bins, self.bins + 1
        else:
            which = self.open[at].pop()
            n[at] -= 1
        if at - size > 0:
            n[at - size] += 1
            self.open.setdefault(at - size, []).append(which)
        return which, c - at


_PLACED = T.StructType(
    [T.StructField("pack_name", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("shard", T.IntegerType()),
     T.StructField("container", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("tokens", T.IntegerType())]
)


def _pack(pieces: pd.DataFrame) -> pd.DataFrame:
    # Longest first within a shard leaves the small pieces to fill gaps.
    pieces = pieces.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    packer = SumOfSquares(int(pieces["capacity"].iloc[0]))
    placed = [packer.place(int(t)) for t in pieces["tokens"]]
    return pieces.assign(container=[p[0] for p in placed], place=[p[1] for p in placed])[[f.name for f in _PLACED]]


def pack(sizes: DataFrame, packs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """pack_name, doc_id, piece, shard, container, place, tokens of (doc_id, tokens) for each of packs.

    (pack_name, shard, container) names a container and place is the piece's first
    token in it. Containers filled by parts of long texts are numbered from -1
    downwards within their shard.
    """
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    once = sizes.where("tokens > 0 and doc_id is not null").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    items = once.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    kinds = packs.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    kind = F.array(*(F.struct(F.lit(k[0]).alias("pack_name"), F.lit(k[1]).alias("capacity")) for k in kinds)) if kinds else F.from_json(F.lit("[]"), "array<struct<pack_name:string,capacity:int>>")
    each = items.withColumn("k", F.explode(kind)).select("doc_id", "tokens", "shard", "k.*")  # each kind is packed whole
    full = F.expr("tokens div capacity").cast("int")
    rest = F.expr("cast(tokens % capacity as int)")
    rests = each.where(rest > 0).select("pack_name", "doc_id", full.alias("piece"), "shard", rest.alias("tokens"), "capacity")
    packed = rests.groupBy("pack_name", "shard").applyInPandas(_pack, _PLACED)
    parts = each.where(full > 0).select("pack_name", "doc_id", "shard", "capacity", F.posexplode(F.sequence(F.lit(1), full)).alias("piece", "_n"))
    w = Window.partitionBy("pack_name", "shard").orderBy("doc_id", "piece")
    parts = parts.select("pack_name", "doc_id", "piece", "shard", (-F.row_number().over(w)).cast("bigint").alias("container"), F.lit(0).alias("place"), F.col("capacity").alias("tokens"))
    return packed.unionByName(parts)


def report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per kind of container: containers, tokens, and the share of room left unused."""
    bins = placed.groupBy("pack_name", "shard", "container").agg(F.sum("tokens").alias("filled"))
    out = bins.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("filled").alias("tokens")).join(packs, "pack_name")
    return out.select("pack_name", "capacity_tokens", "containers", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"))
