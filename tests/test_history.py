"""Type-two history: bulk equals snapshot by snapshot; gaps, returns, nulls, late rows."""

import random

from tracemill.operators import history as h

COLS = "scope string, entity string, snapshot_no int, state_hash string"


def brute(rows):
    by, have = {}, {}
    for s, e, n, v in rows:
        by.setdefault((s, e), {})[n] = v
        have.setdefault(s, set()).add(n)
    out = set()
    for (s, e), states in by.items():
        run = None
        for n in sorted(have[s]):
            v = states.get(n)
            if n in states and run and run[2] == v:
                run[1] = n
            else:
                if run:
                    out.add((s, e, run[0], run[1], run[2]))
                run = [n, n, v] if n in states else None
        if run:
            out.add((s, e, run[0], run[1], run[2]))
    return out


def dim_rows(dim):
    return {tuple(r) for r in dim.select("scope", "entity", "first_snapshot", "last_snapshot", "state_hash").collect()}


def sample(seed):
    rnd = random.Random(seed)
    return [(s, f"e{e}", n, rnd.choice("ab")) for s in "xy" for e in range(5) for n in (0, 1, 2, 4, 7, 8) if rnd.random() < 0.8] + [("z", None, 1, "a"), (None, "e0", 3, "a"), (None, "e0", 5, "a")]


def test_bulk_and_incremental(spark):
    rows = sample(3)
    df = spark.createDataFrame(rows, COLS)
    assert dim_rows(h.scd2_merge(None, df)) == brute(rows)
    dim = None
    for low, high in ((0, 2), (2, 5), (5, 9)):
        dim = h.scd2_merge(dim, df.where(f"snapshot_no >= {low} and snapshot_no < {high}")).checkpoint()
    assert dim_rows(dim) == brute(rows)


def test_store_equals_bulk_and_rewrites_only_touched_buckets(spark):
    from tracemill.session import work_path

    rows = sample(5)
    df = spark.createDataFrame(rows, COLS)
    store = h.HistoryStore(spark, work_path(spark, "history"), 4)
    for n in sorted({r[2] for r in rows}):
        store.merge(df.where(f"snapshot_no = {n}"))
    assert dim_rows(store.versions()) == brute(rows)
    again = h.HistoryStore(spark, store.path)
    before = dict(again.state["open"])
    again.merge(spark.createDataFrame([("x", "e0", 20, "b")], COLS))
    assert sum(before[b] != g for b, g in again.state["open"].items()) == 1
    assert dim_rows(again.versions()) == brute(rows + [("x", "e0", 20, "b")])


def test_late_rows_are_told(spark):
    dim = h.scd2_merge(None, spark.createDataFrame([("x", "a", 5, "v")], COLS))
    new = spark.createDataFrame([("x", "a", 4, "w"), ("x", "a", 6, "v")], COLS)
    assert [r.snapshot_no for r in h.late_rows(dim, new).collect()] == [4]
    assert dim_rows(h.scd2_merge(dim, new)) == {("x", "a", 5, 6, "v")}


def test_states_reduce_rows(spark):
    cols = "run_id string, skill_id string, snapshot_no int, ingested_at string, bank_row bigint, version string, enabled boolean, content string, extra int, scope string"
    data = [
        ("r", "a", 0, "2024-01-01", 1, None, True, "one  two\n", 1, "q"),
        ("r", "a", 1, "2024-01-01", 2, None, True, " one two", 1, "q"),
        ("r", "a", 1, None, 3, "v", True, "other", 1, "q"),
        ("r", "a", 2, "2024-01-01", 4, "", True, "one two", 1, "q"),
        ("r", "a", 2, "2024-01-01", 5, "", None, "one two", 1, "q"),
        ("r", "a", None, "2024-01-01", 6, "", None, "one two", 1, "q"),
    ]
    states = h.skillbank_states(spark.createDataFrame(data, cols))
    assert {(r.first_snapshot, r.last_snapshot) for r in h.scd2_merge(None, states).collect()} == {(0, 1), (2, 2)}
    assert h.scd2_merge(None, states.limit(0)).count() == 0
