"""Containers and mixtures: invariants, whole results, shares, repeats."""

import pytest
from pyspark.sql import functions as F

from tracemill.llm import mixing as mx, packing as pk
from tracemill.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def brute_place(sizes, c):
    """Every placement tried, the sum of squares computed anew."""
    bins, out = [], []
    for s in sizes:
        def cost(i):
            new = bins + [c] if i == len(bins) else list(bins)
            new[i] -= s
            n = {}
            for g in new:
                if 0 < g < c:
                    n[g] = n.get(g, 0) + 1
            return sum(v * v for v in n.values())

        ways = [i for i in range(len(bins)) if bins[i] >= s] + [len(bins)]
        best = min(cost(i) for i in ways)
        out.append(best)
        i = next(i for i in ways if cost(i) == best)
        if i == len(bins):
            bins.append(c)
        bins[i] -= s
    return out


def test_each_step_takes_the_smallest_sum():
    import random

    rnd = random.Random(2)
    sizes = [rnd.randint(1, 12) for _ in range(60)]
    p = pk.SumOfSquares(12)
    loads = {}
    for s in sizes:
        before = dict(loads)
        which, at = p.place(s)
        assert at == loads.get(which, 0)
        loads[which] = at + s
        assert loads[which] <= 12
        cost = lambda ld: sum(v * v for v in __import__("collections").Counter(12 - x for x in ld.values() if x < 12).values())
        ways = [cost({**before, w: x + s}) for w, x in before.items() if x + s <= 12] + [cost({**before, "new": s})]
        assert cost(loads) == min(ways)
    assert sum(loads.values()) == sum(sizes)


def packed(spark, sizes, shard=4_000_000):
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens int")
    packs = spark.createDataFrame([("s", 10), ("m", 25), ("bad", 0), ("none", None)], "pack_name string, capacity_tokens int")
    return pk.pack(df, packs, shard), df, packs


@pytest.mark.parametrize("shard", [50, 4_000_000])
def test_nothing_lost_or_split_needlessly(spark, shard):
    sizes = [(i, (i * 7) % 23 + 1) for i in range(60)] + [(100, 95), (101, 0), (102, None), (None, 5), (5, 36)]
    rows = packed(spark, sizes, shard)[0].collect()
    assert {r.pack_name for r in rows} == {"s", "m"}
    want = {i: t for i, t in sizes if i is not None and t} | {5: 36}
    for name, c in (("s", 10), ("m", 25)):
        mine = [r for r in rows if r.pack_name == name]
        got, fill = {}, {}
        for r in mine:
            got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
            fill.setdefault((r.shard, r.container), []).append((r.place, r.tokens))
        assert got == want
        assert all(len([r for r in mine if r.doc_id == i]) == 1 for i, t in want.items() if t <= c)
        for parts in fill.values():
            at = 0
            for p, t in sorted(parts):
                assert p == at
                at += t
            assert at <= c


def test_empty_and_report(spark):
    p, df, packs = packed(spark, [])
    assert p.count() == 0
    p, df, packs = packed(spark, [(1, 10), (2, 5), (3, 5)])
    assert {(r.pack_name, r.containers, r.unused_share) for r in pk.report(p, packs).collect()} == {("s", 2, 0.0), ("m", 1, 0.2)}


def test_token_counts(spark):
    long = "长文本 " * 30_000
    df = spark.createDataFrame([("hello world",), ("",), (None,), (long,), ("啊" * 60_000,)], "t string")
    got = [r[0] for r in df.select(pk.token_count(F.col("t"))).collect()]
    assert got[0] in (2, 3) and got[1] == 0 and got[2] == 0 and got[3] > 30_000 and got[4] > 0


DOCS = "doc_id bigint, source string, tokens int, weight double"


def mixed(spark, docs, targets, total=None):
    chosen, shares = mx.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), total)
    return {(r.source, r.doc_id): r for r in chosen.collect()}, {r.source: r for r in shares.collect()}


def test_shares_repeats_and_spelling(spark):
    docs = [(i, " Big Source" if i % 2 else "BIG-SOURCE ", 10, 1.0) for i in range(1000)] + [(5000 + i, "small", 10, 1.0) for i in range(30)] + [(9000, None, 10, 1.0), (9001, "other", 10, 1.0), (9002, "small", None, 1.0), (9003, "small", 0, 1.0), (None, "small", 10, 1.0)]
    targets = [("big_source", 0.6, 1), ("small", 0.2, 4), ("nowhere", 0.2, 3), ("zero", 0.0, 1), (None, 0.1, 1)]
    chosen, shares = mixed(spark, docs, targets)
    assert set(shares) == {"big_source", "small", "nowhere"}
    assert shares["big_source"].reached_share == pytest.approx(0.75, abs=0.01) and shares["small"].reached_share == pytest.approx(0.25, abs=0.01)
    assert shares["nowhere"].used_tokens == 0
    assert {k[0] for k in chosen} == {"big_source", "small"} and all(r.repeats <= {"big_source": 1, "small": 4}[r.source] for r in chosen.values())
    assert all(chosen["small", 5000 + i].repeats == 4 for i in range(30))


def test_whole_epochs_come_first(spark):
    docs = [(i, "s", 10, 1.0) for i in range(100)]
    chosen, shares = mixed(spark, docs, [("s", 1.0, 5)], total=2550)
    assert sorted({r.repeats for r in chosen.values()}) == [2, 3] and len(chosen) == 100 and shares["s"].used_tokens == 2550
    again, _ = mixed(spark, docs[::-1], [("s", 1.0, 5)], total=2550)
    assert {k: r.repeats for k, r in chosen.items()} == {k: r.repeats for k, r in again.items()}


def test_weights_pull(spark):
    docs = [(i, "s", 10, 5.0 if i < 1000 else 0.5) for i in range(2000)]
    chosen, _ = mixed(spark, docs, [("s", 1.0, 1)], total=5000)
    assert sum(i < 1000 for _, i in chosen) > 400


def test_ranges_agree_with_one_sorted_list(spark, monkeypatch):
    docs = [(i, "s", i % 37 + 1, 1.0 + i % 3) for i in range(3000)]
    whole, _ = mixed(spark, docs, [("s", 1.0, 1)], total=20_000)
    monkeypatch.setattr(mx, "RANGE_ROWS", 100)
    monkeypatch.setattr(mx, "BINS", 8)
    parts, shares = mixed(spark, docs, [("s", 1.0, 1)], total=20_000)
    assert set(whole) == set(parts) and 20_000 - 37 <= shares["s"].used_tokens <= 20_000
    assert len(mixed(spark, docs, [("s", 1.0, 2)], total=10**9)[0]) == 3000


def test_empty_mix(spark):
    chosen, shares = mixed(spark, [], [("s", 1.0, 1)])
    assert chosen == {} and shares["s"].used_tokens == 0


def test_weight_looks_at_the_whole_text(spark):
    opening = "".join(chr(0x4E00 + i) for i in range(256))
    texts = [opening * 2, opening + "a" * 256, opening + "a" * 100_000, "abab", "", "\n" * 10, "😀b" * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.w for r in df.orderBy("i").select(mx.quality_weight(F.col("t")).alias("w")).collect()]

    def brute(t):
        variety = sum(len(set(t[a : a + 256])) for a in range(0, len(t), 256)) / max(1, len(t))
        return 0.25 + min(len(t) / 2000, 1) + 0.75 * variety

    assert got == pytest.approx([brute(t) for t in texts])
    assert got[0] > got[1] + 0.3
