"""Balancing, components, experiment design, traces, streams and sources by invariants and planted effects."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import balance as b, components as cc, experiment as ex, retrieval as rt, traces as tr
from tracemill.sources import logs
from tracemill.streaming import flows

GRID = [(n, k, cap) for n in (1, 7, 40) for k in (1, 2, 4) for cap in (10, 64)]


@pytest.mark.parametrize("n,k,cap", GRID)
def test_schedule_invariants(n, k, cap):
    rnd = random.Random(n * k + cap)
    sizes = [rnd.randint(1, 30) for _ in range(n)]
    placed = b.schedule_step(sizes, k, cap)
    load = {}
    for s, p in zip(sizes, placed, strict=True):
        load.setdefault(p, []).append(s)
    assert all(sum(v) <= cap or len(v) == 1 for v in load.values())
    assert {r for r, _ in placed} <= set(range(k))
    bins = b.first_fit(sizes, cap)
    assert len(bins) == n and max(bins) < n
    parts = b.differencing(sizes, k)
    assert sorted(i for p in parts for i in p) == list(range(n))
    assert sorted(i for p in b.greedy(sizes, k) for i in p) == list(range(n))


def test_differencing_is_balanced():
    sizes = [random.Random(1).randint(1, 100) for _ in range(64)]
    sums = [sum(sizes[i] for i in p) for p in b.differencing(sizes, 8, equal=True)]
    assert max(sums) - min(sums) <= 20 and all(len(p) == 8 for p in b.differencing(sizes, 8, equal=True))
    assert b.byte_chunks([5, 5, 1, 20, 1], 10) == [0, 0, 1, 1, 2]
    assert sorted(map(len, b.split_to([[0, 1, 2], [3]], [5, 4, 3, 2], 3))) == [1, 1, 2]


def brute_components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, k in links:
        if r is not None:
            find(r)
            if k is not None:
                find(("k", k))
                parent[find(r)] = find(("k", k))
    groups = {}
    for r, _ in links:
        if r is not None:
            groups.setdefault(find(r), set()).add(r)
    return {r: min(g) for g in groups.values() for r in g}


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randint(0, 150), rnd.choice([None, *range(90)])) for _ in range(260)] + [(200 + i, f"c{i // 2}") for i in range(40)] + [(200 + i, f"d{(i + 1) // 2}") for i in range(40)] + [(None, 3), (999, None)]
    links = [(r, None if k is None else str(k)) for r, k in links]
    df = spark.createDataFrame(links, "r bigint, k string")
    assert {r.r: r.component for r in cc.components(df, "r", "k").collect()} == brute_components(links)
    assert cc.components(df.limit(0), "r", "k").count() == 0


def test_whole_group_split(spark):
    groups = spark.createDataFrame([(i, s) for i, s in enumerate([7, 5, 5, 3, 3, 3, 2, 1])], "component bigint, size bigint")
    got = cc.whole_group_split(groups, 11, "s", "test").where("split = 'test'")
    assert got.agg(F.sum("size")).first()[0] == 11
    with pytest.raises(ValueError):
        cc.whole_group_split(groups.where("size > 2"), 4, "s", "test")
    assert cc.subset_of_sizes({4: 2}, 0) == {}


def test_planted_effects_and_singular_design(spark):
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 2, (400, 2))
    y = 0.3 * x[:, 0] - 0.2 * x[:, 1]
    df = spark.createDataFrame([(int(a), int(c), float(v)) for (a, c), v in zip(x, y, strict=True)], "a int, b int, y double")
    for parts in (1, 7):
        got = {r.factor: r.coefficient for r in ex.ols_no_intercept(df.repartition(parts), ["a", "b"], "y").collect()}
        assert got["a"] == pytest.approx(0.3) and got["b"] == pytest.approx(-0.2)
    with pytest.raises(ValueError):
        ex.ols_no_intercept(df.withColumn("b", F.col("a")), ["a", "b"], "y")


def test_bootstrap(spark):
    rnd = np.random.default_rng(1)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(rnd.normal(1.0, 1.0, 400))], "metric string, id int, delta double")
    r = ex.bootstrap_interval(df, "metric", "delta", draws=400).first()
    again = ex.bootstrap_interval(df.repartition(5), "metric", "delta", draws=400).first()
    assert r.low < r.mean < r.high and r.high - r.low == pytest.approx(0.196, abs=0.05) and r.n == 400
    assert again.low == pytest.approx(r.low) and again.high == pytest.approx(r.high)


def test_pairing_drops_incomplete(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "a", 2.0), (1, "b", 3.0), (2, "a", 5.0), (3, "b", None), (3, "a", 1.0)], "t int, arm string, v double")
    assert [tuple(r) for r in ex.paired(df, "arm", "a", "b", "t", F.col("v")).collect()] == [(1, 1.0, 3.0, -2.0)]


def test_dense_top_equals_brute_force(spark):
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(120, 8)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None)], "id bigint, v array<double>")
    got = {}
    for r in rt.dense_top(df, "id", "v", F.col("id") % 20 == 0, 5, block=2).collect():
        got.setdefault(r.query_id, []).append((r.hit_rank, r.hit_id))
    for q in range(0, 120, 20):
        s = np.round(v @ v[q], 5)
        want = [i for i in sorted(range(120), key=lambda i: (-s[i], i)) if i != q][:5]
        assert [i for _, i in sorted(got[q])] == want


def test_bm25_nulls_and_ties(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, None), (4, ""), (5, "blue box and more words")], "d bigint, t string")
    q = spark.createDataFrame([(0, "red"), (0, "red"), (1, "none")], "query_id int, term string")
    assert [(r.doc, r.hit_rank) for r in rt.bm25(docs, "d", {"t": 1.0}, q, 10).orderBy("hit_rank").collect()] == [(1, 1), (2, 2)]
    toks = spark.createDataFrame([("红色保温杯 USB-C x 杯 红色",), (None,)], "t string").select(rt.search_tokens(F.col("t"))).collect()
    assert toks[0][0] == ["红色", "色保", "保温", "温杯", "杯", "usb-c", "x"] and toks[1][0] == []


def test_traces(spark):
    ev = spark.createDataFrame([(1, 0, "start", 10), (1, 1, "start", 11), (1, 2, "end", 10), (1, 3, "start", 12), (1, 4, "end", 99)], "s bigint, seq bigint, kind string, span_id bigint")
    assert {r.span_id: (r.parent_id, r.depth) for r in tr.infer_parents(ev, "s").collect()} == {10: (None, 0), 11: (10, 1), 12: (11, 1)}
    sp = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 2, 1.0, 2.0), (1, 3, 2.0, 9.0), (1, 4, 5.0, 6.0)], "s bigint, span_id bigint, start_at double, end_at double")
    assert {r.span_id: r.lane for r in tr.lanes(sp, "s").collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    t = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a", "b", "c"]), (1, 2, ["a", "b", "x"]), (1, 3, ["q"])], "s bigint, call_no bigint, messages array<string>")
    assert [r.drift for r in tr.message_trie(t, "s").orderBy("call_no").collect()] == ["clean", "clean", "realign", "fork"]
    a = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (1, 3, False)], "b int, seq int, keep boolean")
    assert {r.seq for r in tr.admit(a, "b", 3).where("admitted").collect()} == {0, 2, 3}
    assert {r.seq for r in tr.admit(a, "b", 1).where("admitted").collect()} == {0}


def test_stream_buffer_over_several_files(spark, tmp_path):
    schema = "group_id bigint, member bigint, reward double, ts timestamp"
    rows = lambda data: spark.createDataFrame([(g, m, r, t) for g, m, r, t in data], "group_id bigint, member bigint, reward double, t string").select("group_id", "member", "reward", F.col("t").cast("timestamp").alias("ts"))
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows([(1, 1, 1.0, "2024-01-01"), (1, 1, 1.0, "2024-01-01"), (2, 1, 0.0, "2024-01-01")]).coalesce(1).write.parquet(src)
    go = lambda: flows.drain(spark, src, schema, check, out, lambda s: flows.group_buffer(s, 2, "400 days"))
    go()
    assert spark.read.schema(flows.BUFFER_OUT).parquet(out).count() == 0
    rows([(1, 2, 0.0, "2024-01-02"), (1, 3, 0.0, "2024-01-02")]).coalesce(1).write.mode("append").parquet(src)
    go()
    rows([(1, 4, 0.0, "2024-01-03")]).coalesce(1).write.mode("append").parquet(src)
    go()
    assert [tuple(r) for r in spark.read.schema(flows.BUFFER_OUT).parquet(out).collect()] == [(1, 2, 0.5, False)]


def test_retry_waves(spark):
    jobs = spark.range(10).select(F.col("id").alias("k"))
    got = {r.k: (r.ok, r.attempts) for r in flows.retry_waves(jobs, lambda p, w: p.withColumn("ok", F.col("k") % 4 < w), "k", 3).collect()}
    assert got == {k: ((k % 4) < 3, min(3, k % 4 + 1)) for k in range(10)}


def test_logs(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x", "v": 1}\n\n{"id": "y"\n{"id": "x", "v": 2}\n')
    lines = logs.json_lines(spark, str(p))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 4]
    r = logs.latest_lines(lines, "$.id").select("attempts", F.try_variant_get("record", "$.v", "int").alias("v")).first()
    assert (r.attempts, r.v) == (2, 2)
    with pytest.raises(Exception, match="bad line 3"):
        logs.json_lines(spark, str(p), strict=True).collect()
    assert logs.read_any(spark, f"{p}@[1:2]").count() == 1
    with pytest.raises(ValueError):
        logs.read_any(spark, "x.csv")
    (tmp_path / "m.log").write_text("perf 3: {'loss': 1.5, 'bad': float, 'n': 'x'}\nperf 4: {'loss': 2, 'flag': True}\nnoise")
    m = logs.metric_log(spark.read.text(str(tmp_path / "m.log")), "value")
    assert {tuple(r) for r in m.collect()} == {(4, "loss", 2.0)}
    (tmp_path / "c.csv").write_text("name,v\na,1.5\n,\n")
    assert [tuple(r) for r in logs.typed_csv(spark, str(tmp_path / "c.csv"), {"name"}).collect()] == [("a", 1.5), (None, None)]
    (tmp_path / "g-1").mkdir()
    (tmp_path / "g-1" / "t.json").write_text('{"a": 1}')
    assert [r.group for r in logs.glob_records(spark, str(tmp_path / "g-*/t.json"), r"g-(\d+)").collect()] == ["1"]
    (tmp_path / "arr.json").write_text(json.dumps([{"a": 1}, {"a": None}]))
    assert logs.json_array(spark, str(tmp_path / "arr.json"), "a int").count() == 2
    h = logs.file_hashes(spark, str(tmp_path / "c.csv")).first()
    assert h.bytes == 15 and h.sha256 == h.text_sha256
    out = str(tmp_path / "out")
    logs.write_new(spark.range(3), out)
    with pytest.raises(Exception):
        logs.write_new(spark.range(3), out)
    with pytest.raises(ValueError):
        logs.write_new(spark.range(3), out + "/", [out])
    logs.replace_json(spark, f"file://{tmp_path}/state.json", {"a": 1})
    logs.replace_json(spark, f"file://{tmp_path}/state.json", {"a": 2})
    assert json.loads((tmp_path / "state.json").read_text()) == {"a": 2}


def test_partition_invariance(spark, small):
    from tracemill.operators import episodes as ep

    e = spark.read.parquet(f"{small}/events.parquet")
    base = {tuple(r) for r in ep.event_episodes(e).select("user_id", "day", "steps", "revisits", "outcome").collect()}
    for n in (1, 7):
        assert {tuple(r) for r in ep.event_episodes(e.orderBy(F.rand(3)).repartition(n)).select("user_id", "day", "steps", "revisits", "outcome").collect()} == base
