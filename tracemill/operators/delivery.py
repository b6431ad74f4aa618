"""Exactly-once selection from messages that were delivered at least once.

``SeenStore`` is a folder with three things, each in runs partitioned by shard (a hash
of the identifier):

* ``dict``: every identifier ever seen with its code, dense within a shard. The encoding
  is exact: identifiers are compared as whole strings. Sorted by hash, so that an ingest
  reads only the blocks that can hold its own identifiers;
* ``seen``: for each shard and container of 65,536 codes a compressed bitmap of the codes
  delivered so far; an ingest writes the bitmaps that it changed;
* ``steps``: what each ingest decided, the replacement record.

``CURRENT`` names the committed runs. An ingest writes beside the old ones and then renames
a new ``CURRENT`` into place, so a failed ingest leaves the store as it was and can be run
again. ``FANOUT`` runs of one level are merged into one of the next.

``ingest`` reduces the arrivals to one per identifier by a partial aggregate (so a message
delivered a billion times sends one row per task); the task of a shard encodes its
identifiers, tests their bits and sets them. An arrival with an unseen bit is the message's
first; one with a seen bit is a copy, whatever its batch. ``holders`` are the copies to use
where the newest counts: of a message's first and later arrivals the newest by ``rank``.

Defined results: a null identifier is never a duplicate and is not stored; among
copies in one ingest the latest ``newest`` wins (NULL first), then the largest row id.
Rows with one ``row_id`` are one delivery, however often they are repeated. The input's
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import hadoop_path
from tracemill.sources.blocks import blocks, expand, grouped, ints, merge_due, write_run
from tracemill.sources.manifest import Manifest

#: Codes per bitmap container.
CONTAINER = 65_536
_DICT = "h bigint, ident string, code bigint, shard int"
_SEEN = "container bigint, bits binary, shard int"


def pack_bits(low: np.ndarray) -> bytes:
    """A container's codes (0..65535) as a compressed bitmap."""
    bits = np.zeros(CONTAINER, dtype=np.uint8)
    bits[low] = 1
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack_bits(blob: bytes | None) -> np.ndarray:
    """A boolean array of 65,536; all false for a missing container."""
    if blob is None:
        return np.zeros(CONTAINER, dtype=bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(blob), dtype=np.uint8)).astype(bool)


def message_key(*parts: Column) -> Column:
    """One string for a composite identifier; NULL where the last part is NULL."""
    return F.when(parts[-1].isNotNull(), F.to_json(F.array(*parts)))


def _stepper(dicts: list[str], seen: list[str], tops: dict[int, int]):
    """Rows (shard, h, ident, rank) sorted by shard and h, encoded, with their bits tested; and the changed bitmaps."""

    def codes(shard: int, h: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.full(len(h), -1, dtype=np.int64)
        for folder in dicts:
            for old, _ in blocks(f"{folder}/shard={shard}", "h", h, ["h", "ident", "code"]):
                o_h, o_ident, o_code = ints(old, "h"), old.column("ident").to_numpy(), ints(old, "code")
                lo = np.searchsorted(o_h, h, "left")
                for i, j in expand(lo, np.searchsorted(o_h, h, "right") - lo):
                    same = ident[i] == o_ident[j]
                    out[i[same]] = o_code[j[same]]
        new = out < 0
        out[new] = tops.get(shard, -1) + 1 + np.arange(int(new.sum()))
        return out, new

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in grouped(batches, lambda t: ints(t, "shard")):
            code, new = codes(shard, ints(rows, "h"), rows.column("ident").to_numpy())
            holds = code // CONTAINER
            touched = np.unique(holds)
            maps = {int(c): np.zeros(CONTAINER, dtype=bool) for c in touched}
            for folder in seen:
                for old, _ in blocks(f"{folder}/shard={shard}", "container", touched, ["container", "bits"]):
                    for c, bits in zip(ints(old, "container"), old.column("bits").to_pylist(), strict=True):
                        if int(c) in maps:
                            maps[int(c)] |= unpack_bits(bits)
            unseen = np.zeros(len(code), dtype=bool)
            for c, bits in maps.items():
                at = np.flatnonzero(holds == c)
                low = code[at] - c * CONTAINER
                unseen[at] = ~bits[low]
                bits[low] = True
            n, m = len(code), len(maps)
            nulls = lambda kind, k: pa.nulls(k, kind)
            both = lambda x, y: pa.chunked_array([*x.chunks, y] if isinstance(x, pa.ChunkedArray) else [x, y])
            yield from pa.table({
                "shard": pa.array(np.full(n + m, shard, np.int32)), "h": both(rows.column("h"), nulls(pa.int64(), m)), "ident": both(rows.column("ident"), nulls(rows.column("ident").type, m)),
                "rank": both(rows.column("rank"), nulls(rows.column("rank").type, m)), "code": both(pa.array(code), nulls(pa.int64(), m)), "is_new": both(pa.array(new), nulls(pa.bool_(), m)),
                "unseen": both(pa.array(unseen), nulls(pa.bool_(), m)), "container": both(nulls(pa.int64(), n), pa.array(list(maps), pa.int64())),
                "bits": both(nulls(pa.binary(), n), pa.array([pack_bits(np.flatnonzero(b)) for b in maps.values()], pa.binary())),
            }).combine_chunks().to_batches()

    return step


class SeenStore:
    """A persistent set of delivered messages (see the module).

    ``shards`` is fixed when the store is made: a task holds one shard's identifiers of one ingest.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 32):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, path)
        self.state = self.manifest.read() or {"shards": shards, "next": 0, "dict": [], "seen": [], "steps": [], "tops": {}}
        self.shards = self.state["shards"]

    def ingest(self, arrivals: DataFrame, ident: Column, row_id: str, newest: list[str]) -> DataFrame:
        """(row_id, unseen) of the best arrival of each identifier; commits them as seen."""
        state, gen = self.state, self.state["next"]
        rank = F.struct(*(x for c in newest for x in (F.col(c).isNotNull().alias(f"has_{c}"), F.col(c).alias(f"by_{c}"))), F.col(row_id).alias("row_id"))
        best = arrivals.select(ident.alias("ident"), rank.alias("rank")).where("ident is not null").groupBy("ident").agg(F.max("rank").alias("rank"))
        best = best.select(F.pmod(F.xxhash64("ident"), F.lit(self.shards)).cast("int").alias("shard"), F.xxhash64("ident").alias("h"), "ident", "rank")
        schema = f"shard int, h bigint, ident string, rank {best.schema['rank'].dataType.simpleString()}, code bigint, is_new boolean, unseen boolean, container bigint, bits binary"
        runs = lambda part: [r["path"] for r in state[part]]
        step = _stepper(runs("dict"), runs("seen"), {int(k): v for k, v in state["tops"].items()})
        rows = best.repartition("shard").sortWithinPartitions("shard", "h", "ident").mapInArrow(step, schema)
        at = f"{self.path}/steps/gen={gen}"
        rows.write.mode("overwrite").parquet(at)
        rows = self.spark.read.schema(rows.schema).parquet(at)
        own = {part: f"{self.path}/{part}/run-{gen}-0" for part in ("dict", "seen")}
        with ThreadPoolExecutor(3) as pool:
            jobs = [
                pool.submit(write_run, rows.where("is_new").select("shard", "h", "ident", "code"), own["dict"], "shard", "h"),
                pool.submit(write_run, rows.where("container is not null").select("shard", "container", "bits"), own["seen"], "shard", "container"),
                pool.submit(rows.where("is_new").groupBy("shard").agg(F.max("code").alias("top")).collect),  # at most a row for each shard
            ]
            tops = {str(r["shard"]): r["top"] for r in [j.result() for j in jobs][2]}
        new = state | {"next": gen + 1, "steps": [*state["steps"], gen], "tops": state["tops"] | tops}
        merged = []
        for part, schema, by in (("dict", _DICT, "h"), ("seen", _SEEN, "container")):
            new[part] = [*state[part], {"path": own[part], "level": 0}]
            while tail := merge_due(new[part]):
                to = f"{self.path}/{part}/run-{gen}-{tail[0]['level'] + 1}"
                olds = [self.spark.read.schema(schema).parquet(r["path"]).withColumn("age", F.lit(i)) for i, r in enumerate(tail)]
                old = reduce(DataFrame.unionByName, olds)
                if part == "seen":  # a later bitmap holds the earlier one's bits
                    old = old.groupBy("shard", "container").agg(F.max_by("bits", "age").alias("bits"))
                write_run(old.drop("age"), to, "shard", by)
                merged += [r["path"] for r in tail]
                new[part] = [r for r in new[part] if r not in tail] + [{"path": to, "level": tail[0]["level"] + 1}]
        self.state = new
        self.manifest.commit(new)
        for path in merged:
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, True)
        return rows.where("code is not null").select(F.col("rank.row_id").alias(row_id), "unseen")

    def holders(self, row_id: str) -> DataFrame:
        """The row id of each message's newest copy over all ingests; a partial aggregate over codes."""
        steps = [self.spark.read.parquet(f"{self.path}/steps/gen={g}").where("code is not null").select("shard", "code", "rank") for g in self.state["steps"]]
        if not steps:
            return self.spark.createDataFrame([], f"{row_id} bigint")
        return reduce(DataFrame.unionByName, steps).groupBy("shard", "code").agg(F.max("rank").alias("rank")).select(F.col("rank.row_id").alias(row_id))


def split_arrivals(arrivals: DataFrame, kept: DataFrame, ident: Column, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows to use, ids of surplus copies): kept and identifier-less rows, and all others.

    Both joins are on the delivery's own id, so a hot message does not skew them.
    """
    surplus = arrivals.where(ident.isNotNull()).select(row_id).join(kept, row_id, "left_anti").distinct()
    return arrivals.join(surplus, row_id, "left_anti"), surplus


def episode_key() -> Column:
    """A run's episode, without regard to surrounding blanks and case."""
    return message_key(F.col("run_id"), F.lower(F.regexp_replace("episode_id", r"^\s+|\s+$", "")))
