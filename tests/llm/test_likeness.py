"""Likeness, near copies and the history index against brute force."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tracemill.llm import history_index as hi, likeness as lk, near_copies as nc  # noqa: E402
from tracemill.session import Scratch, ship_package, work_path  # noqa: E402
from tracemill.sources import blocks  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta 商品 核对 预算 尺寸 颜色 退货 warm cold large small".split()


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def texts(n, seed):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            w = rnd.choice(out).split()
            for _ in range(rnd.randint(0, 6)):
                i = rnd.randrange(len(w))
                w[i : i + 1] = rnd.choice([[], [rnd.choice(WORDS)], [w[i], f"x{rnd.randint(0, 99)}"]])
                w = w or ["z"]
            out.append(" ".join(w))
        else:
            out.append(" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 300)) for _ in range(rnd.randint(4, 40))))
    return out


def test_plain_and_runs(spark):
    df = spark.createDataFrame([("Ab-c, 1２é!",), ("...",), (None,)], "t string")
    assert [r[0] for r in df.select(lk.plain(F.col("t"))).collect()] == ["abc1２é", "", None]
    assert len(lk.run_hashes("abcd")) == 0 and len(lk.run_hashes("abcde")) == 1 and len(lk.run_hashes("aaaaaaaa")) == 1
    long = "x" * 10 + "".join(chr(0x4E00 + i % 5000) for i in range(100_000))
    assert len(lk.run_hashes(long)) == len(brute.runs(long))
    assert lk.like_runs(lk.run_hashes(long), lk.run_hashes(long))


def test_near_copies_equal_brute_force(spark):
    rows = [("f", f"id{i % 130}", t) for i, t in enumerate(texts(200, 1))] + [("f", "id1", None), ("f", None, "alpha1 beta2 gamma3"), ("f", "idz", "a-b"), ("g", "id1", "same text here"), ("g", "id2", "Same, text HERE")]
    df = spark.createDataFrame(rows, "scope string, id string, text string")
    with Scratch(spark) as tmp:
        t, m = nc.distinct_texts(df, tmp)
        links = nc.like_texts(t, tmp)
        got = {tuple(r) for r in nc.like_ids(links, m).select("scope", "id_a", "id_b").collect()}
        want = {(s, *p) for s in "fg" for p in brute.like_pairs([(i, x) for q, i, x in rows if q == s])}
        assert got == want and ("g", "id1", "id2") in got
        classes = {}
        for r in m.join(nc.text_classes(t, links, tmp), "tid").collect():
            classes.setdefault(r.class_id, set()).add((r.scope, r.id))
    assert any(len(v) > 1 for v in classes.values())


def test_near_copies_empty(spark):
    df = spark.createDataFrame([], "scope string, id string, text string")
    with Scratch(spark) as tmp:
        t, m = nc.distinct_texts(df, tmp)
        links = nc.like_texts(t, tmp)
        assert nc.like_ids(links, m).count() == 0 and nc.text_classes(t, links, tmp).count() == 0


def lines(seed, n=150):
    rnd = random.Random(seed)
    out = [(rnd.randint(0, 5), i, rnd.choice([None, *(f"c{j}" for j in range(n))]), rnd.choice([None, None, "fam1", "fam2"]), rnd.choice([t, t, t, None, "ab"])) for i, t in enumerate(texts(n, seed))]
    return out


SCHEMA = "batch_no int, ledger_row bigint, candidate_id string, fam string, content string"
COLUMNS = (["batch_no", "ledger_row"], "ledger_row", "candidate_id", "fam", "content")


@pytest.mark.parametrize(("leaders", "one_task", "together"), [(64, 10**6, False), (64, 0, False), (2, 10**6, False), (1, 0, True)])
def test_history_equals_line_by_line(spark, leaders, one_task, together):
    """By one task or by rounds, with hot keys or without, batch by batch or as one batch."""
    data = lines(7)
    df = spark.createDataFrame(data, SCHEMA).withColumn("tid", F.lit(1))
    index = hi.AcceptedIndex(spark, work_path(spark, "accepted"), buckets=4, leaders=leaders, one_task=one_task)
    parts = [df] if together else [df.where(F.col("batch_no") == b) for b in range(6)]
    out = index.ingest([p.unionByName(p.limit(2)) for p in parts], *COLUMNS).collect()
    assert len(out) == len(data) and {x[0] for x in out if not x[1]} == brute.refused(data)


def test_history_empty_and_reopened(spark):
    path = work_path(spark, "accepted")
    go = lambda data: {r[0] for r in hi.AcceptedIndex(spark, path).ingest([spark.createDataFrame(data, SCHEMA)], *COLUMNS).where("not accepted").collect()}
    assert go([]) == set()
    assert go([(0, 1, "a", None, "one two three four"), (0, 2, "b", "f", "one two three four")]) == set()
    assert go([(1, 3, "a", None, "quite another text"), (1, 4, "x", None, "One two, three four!"), (1, 5, "y", "g", "one two three four"), (1, 6, None, None, None), (1, 7, None, None, None)]) == {3, 4}


def test_history_is_probed_not_read(spark):
    """What a probe reads depends on its batch, not on the history; runs are merged as they grow."""
    index = hi.AcceptedIndex(spark, work_path(spark, "accepted"), buckets=2, block=4096)
    big = texts(1200, 11)
    frame = lambda ts, at: spark.createDataFrame([(0, at + i, f"n{at + i}", None, t) for i, t in enumerate(ts)], SCHEMA)
    one = frame([big[0] + " and more words"], 9000)
    index.ingest([frame(big[:300], 0)], *COLUMNS)
    assert index.ingest([one], *COLUMNS, measure=True).first()[1] is False
    small = index.bytes_read[0]
    index.ingest([frame(big[300:], 300)], *COLUMNS)
    index.ingest([frame([big[1] + " and more words"], 9100)], *COLUMNS, measure=True)
    later = index.bytes_read[0]
    index.ingest([frame(big[:200], 10000)], *COLUMNS, measure=True)
    assert 0 < later < 3 * small + 64 * 8192 and index.bytes_read[0] > 2 * later
    index.ingest([frame([f"unrelated words number {i} of the run"], 20000 + i) for i in range(5)], *COLUMNS)
    assert len(index.state["runs"]) < hi.FANOUT
    assert index.ingest([one], *COLUMNS).first()[1] is False


@pytest.mark.parametrize(("leaders", "one_task"), [(64, 10**6), (64, 0), (1, 10**6)])
def test_history_in_parts_and_merged(spark, monkeypatch, leaders, one_task):
    """Buckets probed in several parts, runs merged in between: still line by line."""
    monkeypatch.setattr(hi, "TASK_TEXTS", 10)
    data = [(i // 15, *x[1:]) for i, x in enumerate(lines(17))]
    df = spark.createDataFrame(data, SCHEMA)
    index = hi.AcceptedIndex(spark, work_path(spark, "accepted"), buckets=2, block=1024, leaders=leaders, one_task=one_task)
    out = index.ingest([df.where(F.col("batch_no") == b) for b in range(10)], *COLUMNS).collect()
    assert len(out) == len(data) and {x[0] for x in out if not x[1]} == brute.refused(data)
    assert any(r["level"] for r in index.state["runs"])


def test_described_equals_single_signatures():
    ts = ["one two three four five".replace(" ", ""), "商品核对预算尺寸颜色", "x" * 40]
    runs, words, keys = lk.described(pa.array(ts), np.array([5, 5, -7]))
    for t, n, w in zip(ts, runs, words, strict=True):
        own = lk.run_hashes(t)
        assert n == len(own) and (lk.sketch(lk.signature(own)) == w).all()
    again = lk.described(pa.array([ts[0], ts[0]]), np.array([5, 6]))[2]
    assert (again[0] == keys[0]).all() and not (again[1] == keys[0]).any() and keys.min() >= 0 and keys.max() < 2**32


def test_merged_slices(tmp_path):
    rnd, want = random.Random(5), []
    for k in range(3):
        values = sorted(rnd.randint(-50, 50) for _ in range(500))
        want += values
        with blocks.file_writer(f"file://{tmp_path}/{k}/a.parquet") as out:
            out(pa.table({"key": values}), 20)
    slices = [t.column("key").to_pylist() for t in blocks.merged_slices([f"file://{tmp_path}/{k}" for k in range(4)], "key", 100)]
    assert sum(slices, []) == sorted(want) and len(slices) > 5 and max(map(len, slices)) < 250


def test_backlog_costs_jobs_by_lines_not_by_batches(spark, tmp_path, monkeypatch):
    """120 batches of a few lines: two ingests, whose jobs don't grow with the number of batches."""
    from tracemill.llm import queries

    assert queries._ingests([(3, 5), (None, 4), (1, 5), (2, 30), (0, 2)], 11) == [[None, 0, 1], [2], [3]]
    data = [((i // 3) - 1 if i >= 3 else None, *x[1:]) for i, x in enumerate(lines(23, 360))]
    schema = SCHEMA.replace(" fam ", " replacement_family_id ")
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/proposal_ledger.parquet")
    monkeypatch.setattr(queries, "INGEST_LINES", 200)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    assert {r[0] for r in queries.p1_found(spark, str(tmp_path)).collect()} == brute.refused(data)
    assert 0 < jobs() - before < 100


def test_recall_of_signatures():
    """Pairs at about 0.6 to 0.7: bands, deletion variants and sketches lose none of 400."""
    rnd, lost, n = random.Random(3), 0, 0
    while n < 400:
        base = [f"{rnd.randrange(10**6):06d}" for _ in range(60)]
        other = list(base)
        for i in rnd.sample(range(60), rnd.randint(8, 12)):
            other[i] = f"{rnd.randrange(10**6):06d}"
        a, b = lk.run_hashes("".join(base)), lk.run_hashes("".join(other))
        if not lk.like_runs(a, b):
            continue
        n += 1
        x, y = lk.signature(a), lk.signature(b)
        agree = sum(bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(lk.sketch(x), lk.sketch(y), strict=True))
        first = bin((int(lk.sketch(x)[0]) ^ int(lk.sketch(y)[0])) & (2**64 - 1)).count("1")
        lost += not ({*lk.band_keys(x)} & {*lk.band_keys(y)}) or not ({*lk.deletion_keys(x)} & {*lk.deletion_keys(y)}) or agree > 256 - lk.SKETCH_AGREE or first > 64 - lk.WORD_AGREE
    assert lost == 0
