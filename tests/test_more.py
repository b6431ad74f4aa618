"""Edge cases of roll-ups, dumps, sources, the registry and sequence metrics."""

import gzip
import hashlib
import sys

import pytest
from pyspark.sql import functions as F

from tracemill.functions import registry, text as tx
from tracemill.functions.common import sorted_rank
from tracemill.operators import components as cc, experiment as ex, rollups as ru, seqmath as sm
from tracemill.session import ship_package, work_path
from tracemill.sources import dumps, logs


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def test_rollups_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, " "), (None, 1.0, "y"), (None, 0.0, None)], "g string, r double, t string")
    got = {r.g: (r.members, r.scored, r.correct) for r in ru.scored_groups(df, ["g"], F.col("r")).collect()}
    assert got == {"a": (2, 1, 1), None: (2, 2, 1)}
    assert [r.g for r in ru.valid_groups(df, "g", F.col("t"), 1).collect()] == ["a", None] or len(ru.valid_groups(df, "g", F.col("t"), 1).collect()) == 2
    none = df.limit(0)
    assert ru.scored_groups(none, ["g"], F.col("r")).count() == 0 and ru.fifo_pop(none, ["r"], 3).count() == 0 and ru.weighted_sample(none, "g", F.col("r"), 3, "s").count() == 0
    rates = ru.group_rates(ru.scored_groups(df, ["g"], F.col("r")).withColumn("run", F.lit(1)), "run").first()
    assert (rates.accepted, rates.dropped, rates.all_wrong_rate, rates.drop_rate) == (1, 1, 0.0, 0.5)


def test_rank_by_ranges(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    got = {r.id: r.rank_no for r in sorted_rank(df, F.col("v"), "id", bins=8).collect()}
    rows = sorted(((r.v is None, r.v or 0, r.id) for r in df.collect()))
    assert got == {i: n + 1 for n, (_, _, i) in enumerate(rows)}
    assert sorted_rank(df.where("id < 0"), F.col("v"), "id").count() == 0


def test_batches_run_on_over_epochs(spark):
    rows = ru.wrapped_batches(spark.range(10), "id", 4, 3, 2, "s").collect()
    assert sorted(r.sample_no for r in rows) == list(range(60)) and {r.batch_no for r in rows} == set(range(8))
    assert all(len({r.id for r in rows if r.epoch == e}) == 10 for e in range(3))


def test_sequences(spark):
    df = spark.sql("select array(0.0D, -1.0D) as n, array(-1.0D, -1.0D) as o, array(1, 0) as m, array() as e")
    n, o, m = F.col("n"), F.col("o"), F.col("m")
    r = df.select(sm.sequence_kl(n, o, m), sm.veto(n, o, m, 3.0), sm.veto(n, o, F.array(F.lit(0), F.lit(0)), 3.0), sm.sequence_kl(n, o, F.array(F.lit(0), F.lit(0)))).first()
    assert tuple(r) == (-1.0, 0, 1, 0.0)
    turns = spark.sql("select array(named_struct('role','user','tokens',2,'step_loss_mask',null), named_struct('role','assistant','tokens',3,'step_loss_mask',1), named_struct('role','assistant','tokens',1,'step_loss_mask',0), named_struct('role','assistant','tokens',0,'step_loss_mask',1)) as t")
    assert turns.select(sm.role_mask(F.col("t"), 1)).first()[0] == [0, 0, 0, 1, 1, 0]


def test_splits_are_exact_and_whole(spark):
    groups = spark.range(60).select("id", F.expr("id div 3").alias("component"))
    rows = cc.split_tasks(groups, "id", {"test": 12, "val": 9}, "s").collect()
    by = {}
    for r in rows:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values()) and sum(r.split == "test" for r in rows) == 12 and sum(r.split == "val" for r in rows) == 9 and len(rows) == 60
    with pytest.raises(ValueError):
        cc.split_tasks(groups, "id", {"test": 10}, "s")


def test_refit_tells_a_singular_design(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 6.0)], "a double, b double, y double")
    assert ex.refit(df, ["a", "b"], "y").first().rank == 1
    one = ex.refit(df, ["a"], "y").first()
    assert one.beta_a == pytest.approx(3.0) and one.rank == 1 and ex.refit(df.limit(0), ["a"], "y").first().rank == 0


def test_slices_in_file_order(spark):
    path = work_path(spark, "slice") + ".parquet"
    spark.range(0, 100, 1, 4).write.parquet(path)
    ids = lambda s: [r[0] for r in logs.read_any(spark, f"{path}@[{s}]").collect()]
    whole = ids("0:")
    assert len(whole) == 100 and ids("10:20") == whole[10:20] and ids("-5:") == whole[-5:] and ids("90:-3") == whole[90:-3] and ids("-10:-8") == whole[-10:-8] and ids("50:50") == []


def test_appended_and_replaced_json(spark):
    path = work_path(spark, "log")
    for rows in ([("a", 1), ("b", 1)], [("a", 2)]):
        logs.append_records(spark.createDataFrame(rows, "k string, v int").coalesce(1), path)
    got = {r.key: r.attempts for r in logs.appended_records(spark, path, "$.k").collect()}
    assert got == {"a": 2, "b": 1}
    assert logs.appended_records(spark, path, "$.k").where("key = 'a'").select(F.try_variant_get("record", "$.v", "int")).first()[0] == 2
    target = f"{path}/state.json"
    for v in ({"x": 1}, {"x": 2}):
        logs.replace_json(spark, target, v)
    assert spark.read.json(target).first().x == 2 and len(got) == 2


def test_dumps(spark, tmp_path):
    template = work_path(spark, "dump") + "-{rollout}"
    dumps.save_dump(spark.range(10), template, "all")
    assert sorted(r[0] for r in dumps.load_dump(spark, template, 7, "id", 5).collect()) == [0, 1, 7, 8, 9]
    with pytest.raises(Exception, match="(?i)exists"):
        dumps.save_dump(spark.range(1), template, "all")
    source, target = str(tmp_path / "a.gz"), str(tmp_path / "a")
    with gzip.open(source, "wb") as f:
        f.write(b"text")
    with pytest.raises(ValueError):
        dumps.unpack_verified(source, target, "0")
    dumps.unpack_verified(source, target, hashlib.sha256(b"text").hexdigest())
    assert open(target, "rb").read() == b"text"
    assert dumps.gzip_hashes(spark, f"file://{source}").first().sha256 == hashlib.sha256(b"text").hexdigest()


def test_plug_ins_are_found(tmp_path, monkeypatch):
    package = tmp_path / "plugs"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "math_task.py").write_text("TASK_TYPE = 'math'\ndef transform(df): return df\ndef validity(df): return df\n")
    (package / "helper.py").write_text("X = 1\n")
    (package / "bad_task.py").write_text("TASK_TYPE = 'bad'\ndef meta(a, b, c): return a\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    r = registry.Registry()
    for k, n in registry.KINDS.items():
        r.kind(k, n)
    with pytest.raises(TypeError):
        registry.discover("plugs", r)
    (package / "bad_task.py").unlink()
    for m in [m for m in sys.modules if m.startswith("plugs")]:
        del sys.modules[m]
    assert registry.discover("plugs", r) == ["math"] and r.get("transform", "math")(1) == 1


def test_text_nulls(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    for c in (tx.normal_query(F.col("t")), tx.model_numbers(F.col("t")), tx.option_text(F.col("t")), tx.title_terms(F.col("t"))):
        rows = [r[0] for r in df.select(c).collect()]
        assert rows[0] is None and not rows[1]
