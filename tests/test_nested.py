"""Nested records against a brute-force reading, with every loose form."""

import json

from tracemill.operators import nested as n
from tracemill.plans.training_core import CASE_LISTS, TRACE_LISTS

RECORDS = [
    None, "", "torn{", '{"steps": [1, null, {"environment": {"observation_state": {"hits": [null, 5, {"a": 1}]}}}]}',
    '{"steps": {"environment": {"observation_state": {"hits": "[1, 2]"}}}, "selected_skills": "one"}', '{"steps": "[{\\"environment\\": {\\"observation_state\\": {\\"hits\\": {\\"x\\": 1}}}}, null]"}',
    '{"steps": [], "selected_skills": null}', "[1, 2]", "5", '{"steps": 0, "selected_skills": false}', '{"steps": "[]"}', '{"steps": "[torn"}', '{"steps": [1]} {"steps": [1, 2]}',
    '{"steps": [[1, 2], "[3]"], "selected_skills": ["a", null, "b"]}',
]


def as_list(v):
    if v is None:
        return []
    if isinstance(v, list):
        return v
    if isinstance(v, str):
        try:
            w = json.loads(v)
            if isinstance(w, list):
                return w
        except ValueError:
            if v.lstrip().startswith("["):
                return [v]
    return [v]


def get(v, *path):
    for p in path:
        v = v.get(p) if isinstance(v, dict) else None
    return v


def brute(k, text):
    try:
        o = json.loads(text)
    except (TypeError, ValueError):
        return set()
    out = {(k, name, i, -1) for name in ("steps", "selected_skills") for i, x in enumerate(as_list(get(o, name))) if x is not None}
    for i, s in enumerate(as_list(get(o, "steps"))):
        out |= {(k, "steps.environment.observation_state.hits", i, j) for j, h in enumerate(as_list(get(s, "environment", "observation_state", "hits"))) if h is not None}
    return out


def test_positions(spark):
    df = spark.createDataFrame(list(enumerate(RECORDS)), "delivery_id bigint, trace string").selectExpr("*", "1 as element", "2 as pos1")
    got = {tuple(r) for r in n.list_elements(df, "delivery_id", "trace", TRACE_LISTS, keep_value=False).collect()}
    assert got == set().union(*(brute(k, t) for k, t in enumerate(RECORDS)))
    assert n.list_elements(df.limit(0), "delivery_id", "trace", TRACE_LISTS).count() == 0


def test_each_key_and_native(spark):
    df = spark.createDataFrame([(1, '{"a": {"actions": ["x", null]}, "b": null, "c": {"actions": "y"}, "d": {"actions": null}}'), (2, "[]")], "case_id bigint, conditions string")
    got = {tuple(r) for r in n.list_elements(df, "case_id", "conditions", CASE_LISTS, keep_value=False).collect()}
    assert got == {(1, "conditions.a.actions", 0, -1), (1, "conditions.c.actions", 0, -1)}
    native = spark.createDataFrame([(1, [("a",), None]), (2, None), (3, [])], "ledger_row bigint, validation_history array<struct<x:string>>")
    assert [(r.ledger_row, r.pos1) for r in n.native_elements(native, "ledger_row", "validation_history").collect()] == [(1, 0)]


def test_child_table_types(spark):
    df = spark.createDataFrame([(1, '{"steps": [{"action": "a", "n": 3}, {"action": 5, "n": "x"}]}')], "delivery_id bigint, trace string")
    rows = n.child_table(df, "delivery_id", "trace", TRACE_LISTS[1], {"action": ("$.action", "string"), "n": ("$.n", "int")}).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a", 3), (1, 1, "5", None)]


def test_long_text(spark):
    text = json.dumps({"steps": [{"raw": "长" * 200_000}] * 3})
    df = spark.createDataFrame([(1, text)], "delivery_id bigint, trace string")
    assert n.list_elements(df, "delivery_id", "trace", TRACE_LISTS, keep_value=False).count() == 3
