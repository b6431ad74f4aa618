"""Spans and conversations of one session: inferred parents, lanes, message tries, admission.

All work on one session's rows in order, in Python by session; a session's length is
bounded by its run. Rows of equal time go by their sequence number.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grouped(df: DataFrame, session: str, f, schema: str) -> DataFrame:
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        return f(rows)

    return df.groupBy(session).applyInPandas(run, schema)


def infer_parents(events: DataFrame, session: str) -> DataFrame:
    """session, span_id, parent_id, depth from (session, seq, kind start|end, span_id).

    The parent is the top of the stack of open spans; an end may close a span below the
    top. Ends without a start are ignored.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        stack, out = [], []
        for r in rows.sort_values("seq").itertuples():
            if r.kind == "start":
                out.append((getattr(r, session), r.span_id, stack[-1] if stack else None, len(stack)))
                stack.append(r.span_id)
            elif r.span_id in stack:
                stack.remove(r.span_id)
        return pd.DataFrame(out, columns=[session, "span_id", "parent_id", "depth"]).astype({"parent_id": "Int64"})

    return _grouped(events, session, one, f"{session} bigint, span_id bigint, parent_id bigint, depth int")


def lanes(spans: DataFrame, session: str) -> DataFrame:
    """session, span_id, lane: the first lane that is free at the span's start (start_at, end_at as numbers)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        free, out = [], []
        for r in rows.sort_values(["start_at", "span_id"]).itertuples():
            at = next((i for i, e in enumerate(free) if e <= r.start_at), len(free))
            free[at : at + 1] = [r.end_at]
            out.append((getattr(r, session), r.span_id, at))
        return pd.DataFrame(out, columns=[session, "span_id", "lane"])

    return _grouped(spans, session, one, f"{session} bigint, span_id bigint, lane int")


def message_trie(turns: DataFrame, session: str) -> DataFrame:
    """session, call_no, node, matched, drift from (session, call_no, messages).

    Calls are put into a trie of messages; ``matched`` is the longest known prefix. clean
    extends the last call, realign rewinds to an inner node of it, fork starts elsewhere.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        children: dict[tuple[int, str], int] = {}
        last: list[int] = [0]
        n, out = 0, []
        for r in rows.sort_values("call_no").itertuples():
            path = [0]
            for m in r.messages:
                step = children.get((path[-1], m))
                if step is None:
                    break
                path.append(step)
            matched = len(path) - 1
            drift = "clean" if path[-1] == last[-1] else "realign" if path[-1] in last and path[-1] else "fork"
            for m in list(r.messages)[matched:]:
                n += 1
                children[path[-1], m] = n
                path.append(n)
            last = path
            out.append((getattr(r, session), r.call_no, path[-1], matched, drift))
        return pd.DataFrame(out, columns=[session, "call_no", "node", "matched", "drift"])

    return _grouped(turns, session, one, f"{session} bigint, call_no bigint, node int, matched int, drift string")


def admit(arrivals: DataFrame, batch: str, need: int, fallback: bool = True) -> DataFrame:
    """batch, seq, admitted from (batch, seq, keep): the first ``need`` kept groups in arrival order.

    With ``fallback`` dropped groups, latest first, make up what is missing once all have
    arrived. Running counts decide, so this is a window, not a loop.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(batch).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.sum(F.col("keep").cast("int")).over(w)
    total = F.sum(F.col("keep").cast("int")).over(Window.partitionBy(batch))
    back = F.sum((~F.col("keep")).cast("int")).over(Window.partitionBy(batch).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    take: Column = F.col("keep") & (kept <= need)
    if fallback:
        take = take | (~F.col("keep") & (back <= need - total))
    return arrivals.select(batch, "seq", take.alias("admitted"))
