"""Replayed streams give the same result from one file and from many in any order."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracemill.plans import catalog
from tracemill.plans.compare import difference, duck
from tracemill.streaming import flows


def test_results_do_not_depend_on_files(spark, small, tmp_path, monkeypatch):
    q = entry.queries()
    one = {tuple(r) for r in q["shop_session_stream"](spark, small).collect()}
    # Latest events first, and a file to a micro-batch.
    spark.read.parquet(f"{small}/events.parquet").repartitionByRange(6, F.desc("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(flows.drain, "__defaults__", (*flows.drain.__defaults__[:-1], 1))
    assert {tuple(r) for r in q["shop_session_stream"](spark, str(tmp_path)).collect()} == one and one
    got = q["group_buffer_stream"](spark, str(tmp_path))
    assert difference(got, catalog.oracle_sql()["group_buffer_stream"], duck(small)) == "" and got.count()
