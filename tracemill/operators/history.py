"""Type-two history of changing entity attributes.

``scd2_merge`` folds one or many snapshots into a dimension of versions. Each
version has the first and last snapshot it was seen in; it is open while its
last snapshot is its scope's newest. Attribute hashes decide: an entity whose
hash equals its current version's, in the directly following snapshot of the
scope, extends that version; otherwise the version is closed and a new one is
inserted. An entity missing from a snapshot closes its version.

The merge takes a whole backlog at once: the open versions enter as the state
before the first new snapshot, one window per entity compares neighbours, and
the result equals merging snapshot by snapshot. Snapshots older than those
already merged for a scope are refused (``late_rows``): they need a rebuild
from the snapshots.

Skew: repeated rows of one (scope, entity, snapshot) are reduced by a partial
aggregate before any shuffle, so a hot key shrinks to one row per snapshot.
The neighbour window only streams over its sorted, spillable partition.

Defined results: null scope, entity or attributes are values equal to
themselves; rows without a snapshot number are left out; among rows of equal
write time the largest tie-break wins, a null write time is earliest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.session import hadoop_path
from tracemill.sources.manifest import Manifest

#: Runs of Unicode white space.
WHITE = r"[\s\u0085   -     　]+"


def squeezed(text: Column) -> Column:
    """Every run of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def attribute_hash(*attributes: Column) -> Column:
    """SHA-256 over the attributes; NULL differs from every value."""
    parts = [F.struct(a.isNull(), a.cast("string")) for a in attributes]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def latest_rows(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Per key the row that is newest by ``newest`` (NULL first), by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*(x for c in newest for x in (F.col(c).isNotNull(), F.col(c))))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, *(F.col("_best")[c].alias(c) for c in rest))


def scd2_merge(dim: DataFrame | None, snapshots: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Merge reduced snapshots into a version dimension.

    ``snapshots``: scope, entity, snapshot_no, state_hash; one row per (scope,
    entity, snapshot_no). ``dim`` (or None): scope, entity, state_hash,
    first_snapshot, last_snapshot, scope_last, where scope_last is the newest
    snapshot merged for the scope. ``heads`` (scope, scope_last) names it also for scopes
    without a version in ``dim``. Returns the new ``dim`` whole.
    """
    # The snapshots a scope has, numbered; with a dimension, counting goes on from its newest.
    have = snapshots.select("scope", "snapshot_no").distinct()
    if dim is not None:
        last = heads if heads is not None else dim.groupBy("scope").agg(F.max("scope_last").alias("scope_last"))
        have = have.join(last, have["scope"].eqNullSafe(last["scope"]), "left").select(have["scope"], "snapshot_no", "scope_last")
        have = have.where("scope_last is null or snapshot_no > scope_last").drop("scope_last")
        snapshots = _same(snapshots, have, ["scope", "snapshot_no"])
    w = Window.partitionBy("scope").orderBy("snapshot_no")
    numbered = have.select("scope", "snapshot_no", F.row_number().over(w).alias("ordinal"))
    tops = numbered.groupBy("scope").agg(F.max("snapshot_no").alias("top"))
    rows = _same(snapshots, numbered, ["scope", "snapshot_no"], ["ordinal"]).select(
        "scope", "entity", "state_hash", "ordinal", F.col("snapshot_no").alias("first"), F.col("snapshot_no").alias("last")
    )
    closed = None
    if dim is not None:
        is_open = F.col("last_snapshot") == F.col("scope_last")
        opened = dim.where(is_open).select(
            "scope", "entity", "state_hash", F.lit(0).alias("ordinal"), F.col("first_snapshot").alias("first"), F.col("last_snapshot").alias("last")
        )
        closed = dim.where(~is_open)
        rows = rows.unionByName(opened)
    key = Window.partitionBy("scope", "entity").orderBy("ordinal")
    same = (F.lag("state_hash").over(key) == F.col("state_hash")) & (F.lag("ordinal").over(key) == F.col("ordinal") - 1)
    rows = rows.withColumn("starts", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("version_no", F.sum("starts").over(key.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("scope", "entity", "version_no").agg(
        F.min("state_hash").alias("state_hash"), F.min("first").alias("first_snapshot"), F.max("last").alias("last_snapshot")
    )
    merged = merged.drop("version_no")
    tops = tops.select(F.col("scope").alias("s2"), "top")
    if dim is None:
        return merged.join(tops, F.col("scope").eqNullSafe(F.col("s2"))).select(*merged.columns, F.col("top").alias("scope_last"))
    old = last.select(F.col("scope").alias("s3"), F.col("scope_last").alias("old_top"))
    out = merged.unionByName(closed.select(*merged.columns))
    out = out.join(tops, F.col("scope").eqNullSafe(F.col("s2")), "left").join(old, F.col("scope").eqNullSafe(F.col("s3")), "left")
    return out.select(*merged.columns, F.coalesce("top", "old_top").alias("scope_last"))


def late_rows(dim: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows whose snapshot is not newer than the newest merged one of their scope."""
    last = dim.groupBy(F.col("scope").alias("s2")).agg(F.max("scope_last").alias("top"))
    return snapshots.join(last, F.col("scope").eqNullSafe(F.col("s2"))).where("snapshot_no <= top").drop("s2", "top")


def _same(left: DataFrame, right: DataFrame, keys: list[str], take: list[str] | None = None) -> DataFrame:
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(take or []))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, "inner").drop(*(f"_r_{k}" for k in keys))


def skillbank_states(bank: DataFrame) -> DataFrame:
    """selected_skillbank reduced to scd2_merge's input: the holding row of each snapshot, hashed."""
    rows = bank.select(
        F.col("run_id").alias("scope"),
        F.col("skill_id").alias("entity"),
        "snapshot_no",
        "ingested_at",
        "bank_row",
        attribute_hash(F.col("version"), F.col("enabled"), squeezed(F.col("content"))).alias("state_hash"),
    ).where("snapshot_no is not null")
    return latest_rows(rows, ["scope", "entity", "snapshot_no"], ["ingested_at", "bank_row"]).select("scope", "entity", "snapshot_no", "state_hash")


_VERSION = "scope string, entity string, state_hash string, first_snapshot int, last_snapshot int, scope_last int, bucket int"


class HistoryStore:
    """A stored version dimension, partitioned into closed and open versions and by a hash of the scope.

    A merge reads the open versions of the buckets that its snapshots touch, and nothing
    else: changed and missing ones are closed and appended, the buckets' open versions
    are written anew, and one rename commits. Closed versions are never read or rewritten,
    nor are open ones of other buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, path)
        self.state = self.manifest.read() or {"buckets": buckets, "next": 0, "open": {}, "closed": []}

    def _read(self, folders: list[str]) -> DataFrame:
        """Versions of the folders that exist; a bucket without open versions has none."""
        there = [f for f in folders if (fs := hadoop_path(self.spark, f))[0].exists(fs[1])]
        parts = [self.spark.read.schema(_VERSION).parquet(f).drop("bucket") for f in there]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _VERSION).drop("bucket")

    def merge(self, snapshots: DataFrame) -> None:
        """Takes in snapshots (scope, entity, snapshot_no, state_hash) newer than those merged for their scopes."""
        state, gen = self.state, self.state["next"]
        bucket = F.pmod(F.xxhash64("scope"), F.lit(state["buckets"])).cast("int")
        touched = [str(r[0]) for r in snapshots.select(bucket.alias("b")).distinct().collect()]  # at most the number of buckets
        at = lambda g, kind, b: f"{self.path}/gen={g}/kind={kind}/bucket={b}"
        olds = [(state["open"][b], b) for b in touched if b in state["open"]]
        dim = self._read([at(g, "open", b) for g, b in olds])
        # A scope's newest snapshot stands in a row of its own, as all its versions may be closed.
        marks = self._read([at(g, "head", b) for g, b in olds])
        heads = marks.select("scope", "scope_last")
        out = scd2_merge(dim, snapshots, heads).select("scope", "entity", "state_hash", "first_snapshot", "last_snapshot", "scope_last")
        kind = F.when(F.col("last_snapshot") == F.col("scope_last"), "open").otherwise("closed")
        new = snapshots.groupBy("scope").agg(F.max("snapshot_no").alias("scope_last")).unionByName(heads).groupBy("scope").agg(F.max("scope_last").alias("scope_last"))
        none = F.lit(None).cast("string")
        new = new.select("scope", none.alias("entity"), none.alias("state_hash"), F.lit(None).cast("int").alias("first_snapshot"), F.lit(None).cast("int").alias("last_snapshot"), "scope_last", F.lit("head").alias("kind"))
        rows = out.withColumn("kind", kind).unionByName(new).withColumn("bucket", bucket)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{self.path}/gen={gen}")
        self.state = state | {"next": gen + 1, "open": state["open"] | {b: gen for b in touched}, "closed": [*state["closed"], gen]}
        self.manifest.commit(self.state)

    def versions(self) -> DataFrame:
        """All versions, closed and open."""
        opened = [f"{self.path}/gen={g}/kind=open/bucket={b}" for b, g in self.state["open"].items()]
        return self._read([f"{self.path}/gen={g}/kind=closed" for g in self.state["closed"]]).unionByName(self._read(opened))
