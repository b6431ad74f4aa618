"""Stateful flows: group buffers, session machines, windows with watermarks, file drains.

Each takes a streaming DataFrame (or a batch one, where Spark allows it) and returns
one; the caller chooses sink, trigger and checkpoint folder. State is keyed, kept in
RocksDB where the session says so, and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUFFER_STATE = "rows array<struct<member:bigint,reward:double>>, done boolean"
BUFFER_OUT = "group_id bigint, members int, mean_reward double, timed_out boolean"


def group_buffer(events: DataFrame, need: int, wait: str = "1 hour") -> DataFrame:
    """Emits a group once, when ``need`` different members have arrived, or when event time passes ``wait``.

    Input: group_id, member, reward, ts (with a watermark set here). A repeated member and
    any member after the group was emitted are ignored; the group's state keeps only that
    it is done, until its time is over.
    """
    limit = int(pd.Timedelta(wait).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, done = ({m: r for m, r in state.get[0]}, state.get[1]) if state.exists else ({}, False)
        if state.hasTimedOut:
            state.remove()
            if not done and rows:
                yield pd.DataFrame([(key[0], len(rows), sum(rows.values()) / len(rows), True)], columns=["group_id", "members", "mean_reward", "timed_out"])
            return
        # A micro-batch's rows of one group; those of a done group are only looked at for the time.
        new = pd.concat(list(batches)).sort_values(["ts", "member"])
        newest = int(new["ts"].max().timestamp() * 1000)
        if not done:
            for m, r in zip(new["member"], new["reward"], strict=True):
                if len(rows) < need:
                    rows.setdefault(int(m), float(r))
        if not done and len(rows) >= need:
            yield pd.DataFrame([(key[0], len(rows), sum(rows.values()) / len(rows), False)], columns=["group_id", "members", "mean_reward", "timed_out"])
            rows, done = {}, True
        state.update(([(m, r) for m, r in rows.items()], done))
        state.setTimeoutTimestamp(max(newest + limit, state.getCurrentWatermarkMs() + 1))

    marked = events.withWatermark("ts", "10 minutes")
    return marked.groupBy("group_id").applyInPandasWithState(step, BUFFER_OUT, BUFFER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


HELD_BUFFER_STATE = "rows array<struct<at:bigint,member:bigint,reward:double>>, newest bigint, done boolean"


def held_group_buffer(events: DataFrame, need: int, wait: str, hold: str) -> DataFrame:
    """As ``group_buffer``, for rows that come in any order within ``hold``.

    A group's first ``need`` different members by event time are kept in state, no more,
    and emitted when the watermark passes the last of them: no earlier one can come then.
    Rows without a member only move the watermark.
    """
    limit = int(pd.Timedelta(wait).total_seconds() * 1000)
    columns = ["group_id", "members", "mean_reward", "timed_out"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, newest, done = state.get if state.exists else ([], 0, False)
        first = {m: (at, m, r) for at, m, r in kept}
        if state.hasTimedOut:
            if not done and first:
                yield pd.DataFrame([(key[0], len(first), sum(x[2] for x in first.values()) / len(first), len(first) < need)], columns=columns)
            if done or len(first) < need:
                state.remove()
                return
            kept, done = [], True
        else:
            new = pd.concat(list(batches)).dropna(subset=["member"])
            if new.empty and not state.exists:
                return
            for at, m, r in zip(new["ts"], new["member"], new["reward"], strict=True):
                at = int(at.value // 1000)
                newest = max(newest, at // 1000)
                if not done:
                    first[int(m)] = min(first.get(int(m), (at, int(m), float(r))), (at, int(m), float(r)))
            kept = [] if done else sorted(first.values())[:need]
        state.update((kept, newest, done))
        due = kept[-1][0] // 1000 + 1 if len(kept) >= need else newest + limit
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    marked = events.withWatermark("ts", hold)
    return marked.groupBy("group_id").applyInPandasWithState(step, BUFFER_OUT, HELD_BUFFER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


SESSION_STATE = "page string, steps int, asin string"
SESSION_OUT = "session_id bigint, page string, steps int, bought string"


def shop_sessions(actions: DataFrame) -> DataFrame:
    """A session walks start, results, product, done by its actions; emitted when it buys.

    Input: session_id, seq, verb, argument. An action that a page does not offer leaves the
    page as it is and counts as a step.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page, steps, asin = state.get if state.exists else ("start", 0, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            if page == "done":
                break
            steps += 1
            if r.verb == "search":
                page, asin = "results", None
            elif r.verb == "open" and page in ("results", "product"):
                page, asin = "product", r.argument
            elif r.verb == "back" and page == "product":
                page = "results"
            elif r.verb == "buy" and page == "product":
                page = "done"
                yield pd.DataFrame([(key[0], page, steps, asin)], columns=["session_id", "page", "steps", "bought"])
        state.update((page, steps, asin))

    return actions.groupBy("session_id").applyInPandasWithState(step, SESSION_OUT, SESSION_STATE, "append", GroupStateTimeout.NoTimeout)


HELD_SESSION_STATE = "page string, steps int, asin string, held array<struct<at:bigint,seq:bigint,verb:string,argument:string>>"


def held_shop_sessions(actions: DataFrame, hold: str) -> DataFrame:
    """As ``shop_sessions``, for actions (with ts) that come in any order within ``hold``.

    Actions wait in state until the watermark passes them, and are walked in the order of
    time and seq. Rows without a seq only move the watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page, steps, asin, held = state.get if state.exists else ("start", 0, None, [])
        rows, mark = [tuple(x) for x in held], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            new = pd.concat(list(batches)).dropna(subset=["seq"])
            if new.empty and not state.exists:
                return
            rows += [(int(at.value // 1000), int(q), v, a) for at, q, v, a in zip(new["ts"], new["seq"], new["verb"], new["argument"], strict=True)]
        rows.sort(key=lambda x: x[:2])
        ready = [x for x in rows if x[0] // 1000 < mark]
        rows = rows[len(ready) :]
        for _, _, verb, argument in ready:
            if page == "done":
                break
            steps += 1
            if verb == "search":
                page, asin = "results", None
            elif verb == "open" and page in ("results", "product"):
                page, asin = "product", argument
            elif verb == "back" and page == "product":
                page = "results"
            elif verb == "buy" and page == "product":
                page = "done"
                yield pd.DataFrame([(key[0], page, steps, asin)], columns=["session_id", "page", "steps", "bought"])
        rows = [] if page == "done" else rows
        state.update((page, steps, asin, rows))
        if rows:
            state.setTimeoutTimestamp(max(rows[0][0] // 1000 + 1, mark + 1))

    marked = actions.withWatermark("ts", hold)
    return marked.groupBy("session_id").applyInPandasWithState(step, SESSION_OUT, HELD_SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(spark: SparkSession, src: DataFrame, folder: str, checkpoint: str, out: str, flow, wait: str = "0 days") -> None:
    """Drains a finite table with a ``ts`` through ``flow(stream, hold)``; the result doesn't depend on the files or their order.

    ``hold`` covers the table's whole time, so no row is late; a closing row of nulls then
    carries the watermark past all rows and ``wait``.
    """
    src.write.parquet(folder)
    low, high = spark.read.schema(src.schema).parquet(folder).select(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    span = ((high or 0) - (low or 0)) // 1_000_000 + 60
    flow_ = lambda s: flow(s, f"{span} seconds")
    drain(spark, folder, src.schema, checkpoint, out, flow_)
    end = (high or 0) + (span + int(pd.Timedelta(wait).total_seconds()) + 60) * 1_000_000
    closing = spark.range(1).select(*(F.timestamp_micros(F.lit(end)).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in src.schema))
    closing.write.mode("append").parquet(folder)
    drain(spark, folder, src.schema, checkpoint, out, flow_)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(win, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def drain(spark: SparkSession, folder: str, schema, checkpoint: str, out: str, transform=lambda df: df, mode: str = "append", max_files: int = 100) -> None:
    """Takes over every new Parquet file of a folder, then stops; a later call goes on from the checkpoint."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    q = transform(src).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def retry_waves(jobs: DataFrame, run, key: str, most: int = 3) -> DataFrame:
    """Runs ``run(pending, wave)`` (returning key, ok) until all are done or had ``most`` attempts.

    key, attempts, ok. Each wave is an anti-join against what is done.
    """
    from tracemill.session import checkpointed

    left, done = jobs.select(key), None
    for wave in range(1, most + 1):
        got = checkpointed(run(left, wave).select(key, "ok").withColumn("attempts", F.lit(wave)))
        ended = got if wave == most else got.where("ok")
        done = ended if done is None else done.unionByName(ended)
        left = checkpointed(left.join(got.where("ok"), key, "left_anti"))
        if left.isEmpty():
            break
    return done
