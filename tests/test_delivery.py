"""Exactly-once selection: copies, batches, nulls, ties, crashes."""

from pyspark.sql import functions as F

from tracemill.operators import delivery as d
from tracemill.session import work_path

SCHEMA = "delivery_id bigint, run_id string, episode_id string, delivered_at timestamp, code string"


def store(spark, shards=4):
    return d.SeenStore(spark, work_path(spark, "seen"), shards)


def ingest(s, df):
    kept = s.ingest(df, d.episode_key(), "delivery_id", ["delivered_at"]).where("unseen").drop("unseen")
    use, surplus = d.split_arrivals(df, kept, d.episode_key(), "delivery_id")
    return sorted(r[0] for r in use.select("delivery_id").collect()), sorted(r[0] for r in surplus.collect())


def rows(spark, data):
    return spark.createDataFrame(data, "delivery_id bigint, run_id string, episode_id string, t string, code string").select("delivery_id", "run_id", "episode_id", F.col("t").cast("timestamp").alias("delivered_at"), "code")


def test_latest_copy_is_kept(spark):
    df = rows(spark, [
        (1, "r", " E1", "2024-01-01", "x"), (2, "r", "e1", "2024-01-02", "x"), (3, "r", "e1 ", None, "x"),
        (4, "s", "e1", "2024-01-01", "x"), (5, "r", None, "2024-01-01", "x"), (6, "r", None, None, "x"),
        (7, None, "e1", None, "x"), (8, None, "e1", None, "x"),
    ])
    assert ingest(store(spark), df) == ([2, 4, 5, 6, 8], [1, 3, 7])


def test_ties_and_repeated_rows(spark):
    df = rows(spark, [(1, "r", "a", "2024-01-01", "x"), (2, "r", "a", "2024-01-01", "x"), (2, "r", "a", "2024-01-01", "x")])
    assert ingest(store(spark), df) == ([2, 2], [1])


def test_empty(spark):
    assert ingest(store(spark), rows(spark, [(1, "r", "a", None, "x")]).limit(0)) == ([], [])


def test_later_batches_are_duplicates_and_codes_go_on(spark):
    s = store(spark)
    assert ingest(s, rows(spark, [(i, "r", f"e{i}", None, "x") for i in range(40)]))[1] == []
    use, surplus = ingest(s, rows(spark, [(100 + i, "r", f"E{i}", "2024-01-01", "x") for i in range(30, 60)]))
    assert surplus == list(range(130, 140)) and len(use) == 20
    again = d.SeenStore(spark, s.path)  # opened anew: the number of shards is the store's
    assert again.shards == 4
    assert ingest(again, rows(spark, [(500, "r", "e55", None, "x"), (501, "r", "new", None, "x")])) == ([501], [500])
    codes = [spark.read.parquet(r["path"]) for r in again.state["dict"]]
    codes = codes[0].unionByName(codes[1]).unionByName(codes[2])
    assert codes.count() == 61 and codes.select("shard", "code").distinct().count() == 61
    # Bits reject arrivals in every batch after the first; the newest copy holds a message.
    assert spark.read.parquet(*(f"{s.path}/steps/gen={g}" for g in again.state["steps"])).where("code is not null and not unseen").count() == 11
    held = {r[0] for r in again.holders("delivery_id").collect()}
    assert len(held) == 61 and {130, 139, 501} <= held and 30 not in held and 155 in held and 500 not in held


def test_runs_are_merged(spark):
    s = store(spark, 2)
    for i in range(10):
        assert ingest(s, rows(spark, [(10 * i + k, "r", f"e{i * 2 + k}", "2024-01-01", "x") for k in range(4)]))[1] == ([] if not i else [10 * i, 10 * i + 1])
    assert len(s.state["dict"]) == 3 and s.holders("delivery_id").count() == 22


def test_failed_ingest_leaves_the_store(spark, monkeypatch):
    s = store(spark)
    df = rows(spark, [(1, "r", "a", None, "x")])
    monkeypatch.setattr(s.manifest, "commit", lambda state: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        ingest(s, df)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert ingest(d.SeenStore(spark, s.path), df) == ([1], [])


def test_bitmaps_round_trip():
    import numpy as np

    low = np.array([0, 1, 65535, 777])
    assert sorted(np.flatnonzero(d.unpack_bits(d.pack_bits(low)))) == sorted(low)
    assert not d.unpack_bits(None).any()
