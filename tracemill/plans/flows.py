"""Queries of packing, spans, streams and sources; most have no SQL twin and are tested by invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text as tx
from tracemill.operators import balance, traces
from tracemill.operators.episodes import event_steps
from tracemill.session import work_path
from tracemill.sources import logs
from tracemill.sources.tables import table
from tracemill.streaming import flows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _step_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a step: a supplier's, in (part, order) sequence, with their quantity as length."""
    l = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") * 10_000_000 + F.col("l_orderkey")).alias("seq"), F.col("l_quantity").cast("bigint").alias("len"))
    return l


@query()
def first_fit_pack(spark, sf):
    return balance.pack_steps(_step_lines(spark, sf), "l_suppkey", "seq", "len", 128)


@query()
def rank_schedule(spark, sf):
    return balance.schedule(_step_lines(spark, sf), "l_suppkey", "seq", "len", 4, 512)


@query("""with recursive n as (select l_suppkey, l_partkey * 10000000 + l_orderkey as seq, l_quantity::bigint as len, row_number() over (partition by l_suppkey order by l_partkey, l_orderkey, l_quantity) as i from lineitem),
r(l_suppkey, seq, i, chunk_no, total) as (select l_suppkey, seq, i, 0, len from n where i = 1 union all select n.l_suppkey, n.seq, n.i, case when r.total >= 100 then r.chunk_no + 1 else r.chunk_no end, case when r.total >= 100 then n.len else r.total + n.len end from r join n on n.l_suppkey = r.l_suppkey and n.i = r.i + 1)
select l_suppkey, seq, chunk_no from r""")
def byte_chunks(spark, sf):
    return balance.chunk_steps(_step_lines(spark, sf), "l_suppkey", "seq", "len", 100)


@query()
def span_parents(spark, sf):
    """Views open spans, clicks on the same object close them; parents from the stack, by user."""
    e = event_steps(table(spark, sf, "events")).where("event_type in ('view', 'click')")
    ev = e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "start").otherwise("end").alias("kind"), F.col("k").cast("bigint").alias("span_id"))
    return traces.infer_parents(ev, "user_id")


@query()
def span_lanes(spark, sf):
    e = event_steps(table(spark, sf, "events"))
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return traces.lanes(e.select("user_id", F.col("event_id").alias("span_id"), t.alias("start_at"), (t + F.col("value") * 3600).alias("end_at")), "user_id")


@query()
def conversation_trie(spark, sf):
    """Growing action sequences of a user's days as calls; drift against the call before."""
    e = event_steps(table(spark, sf, "events")).groupBy("user_id", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("messages"))
    return traces.message_trie(e.select("user_id", F.unix_date("day").cast("bigint").alias("call_no"), "messages"), "user_id")


@query("""with a as (select event_id, user_id, event_type in ('purchase', 'click') as keep from events), w as (select *, sum(keep::int) over (partition by user_id order by event_id) as kept, sum(keep::int) over (partition by user_id) as total,
sum((not keep)::int) over (partition by user_id order by event_id desc) as back from a) select user_id, event_id as seq, (keep and kept <= 32) or (not keep and back <= 32 - total) as admitted from w""")
def oversampled_admission(spark, sf):
    a = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").isin("purchase", "click").alias("keep"))
    return traces.admit(a, "user_id", 32)


@query("""with e as (select user_id as group_id, event_id as member, value from events qualify row_number() over (partition by user_id order by event_id) <= 20)
select group_id, count(*)::int as members, round(avg(value), 6) as mean_reward from e group by 1 having count(*) = 20""")
def group_buffer_stream(spark, sf):
    """The buffer as a stream over the events' file, drained; a group's first 20 members by event number."""
    src = table(spark, sf, "events").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("member"), F.col("value").alias("reward"), F.col("ts").cast("timestamp").alias("ts"))
    folder, out, check = (work_path(spark, n) for n in ("stream-in", "stream-out", "stream-check"))
    flows.replay(spark, src, folder, check, out, lambda s, hold: flows.held_group_buffer(s, 20, "400 days", hold), "400 days")
    got = spark.read.schema(flows.BUFFER_OUT).parquet(out)
    return got.where("not timed_out").select("group_id", "members", F.round("mean_reward", 6).alias("mean_reward"))


@query("""select date_trunc('hour', ts) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2""")
def windowed_stream(spark, sf):
    """Tumbling hours as a stream with a watermark, in complete mode over one drained file."""
    src = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    folder, check, name = work_path(spark, "win-in"), work_path(spark, "win-check"), f"win_{abs(hash(sf))}"
    src.write.parquet(folder)
    s = flows.windowed_counts(spark.readStream.schema(src.schema).parquet(folder), "1 hour")
    out = work_path(spark, "win-out")

    def put(batch, _):
        batch.write.mode("overwrite").parquet(out)

    s.writeStream.outputMode("complete").queryName(name).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def shop_session_stream(spark, sf):
    e = event_steps(table(spark, sf, "events"))
    verb = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "buy").otherwise("back")
    src = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), verb.alias("verb"), F.col("k").cast("string").alias("argument"), F.col("ts").cast("timestamp").alias("ts"))
    folder, out, check = (work_path(spark, n) for n in ("shop-in", "shop-out", "shop-check"))
    flows.replay(spark, src, folder, check, out, flows.held_shop_sessions)
    return spark.read.schema(flows.SESSION_OUT).parquet(out)


@query("select event_id, k from (select event_id, cast(json_extract_string(props, '$.k') as int) as k, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def json_log_roundtrip(spark, sf):
    """Events as JSON lines in a file, read back with line numbers; the last line of each user wins."""
    e = table(spark, sf, "events").select("user_id", "event_id", "props").orderBy("event_id")
    path = work_path(spark, "log")
    e.coalesce(1).sortWithinPartitions("event_id").select(F.to_json(F.struct("user_id", "event_id", "props")).alias("value")).write.text(path)
    last = logs.latest_lines(logs.json_lines(spark, path), "$.user_id")
    return last.select(F.try_variant_get("record", "$.event_id", "bigint").alias("event_id"), F.get_json_object(F.try_variant_get("record", "$.props", "string"), "$.k").cast("int").alias("k"))


@query()
def compression_ratios(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.round(tx.compression_ratio(F.col("text")), 6).alias("zlib_ratio"), tx.is_repetitive(F.col("text")).alias("repetitive"))


@query()
def folded_queries(spark, sf):
    return table(spark, sf, "tasks").select("task_id", tx.normal_query(F.col("instruction")).alias("query"))


@query()
def trace_fingerprints(spark, sf):
    """Canonical fingerprints of the logged records; torn ones have none."""
    return table(spark, sf, "traces").select("delivery_id", tx.fingerprint(F.col("trace")).alias("fingerprint"))
