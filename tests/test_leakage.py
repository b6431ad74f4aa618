"""Known titles, brands and options in texts, against a plain search; the rules over the ledger."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracemill.operators import leakage as lk
from tracemill.session import ship_package


def trace(title=None, brand=None, goal=None, options=None, single=False):
    step = {"environment": {"observation_state": {"product": {"title": title, "brand": brand}}}}
    return json.dumps({"final": {"goal": {"name": goal, "goal_options": options}}, "steps": step if single else [{"environment": None}, step]}, ensure_ascii=False)


TRACES = [trace(" 栖岚加厚瑜伽垫 ", "栖岚芽"), trace("Quibri travel mug", "Quibri", single=True), trace(goal="Lulu towel set", options=["墨绿色加大款", "red", 3]), trace("short", "ab"), "{torn", None, "[]", trace(options="no list")]
TEXTS = ["### 栖岚加厚瑜伽垫与大号", "a Quibri travel mug", "以 墨绿色加大款 为准", "nothing", "", "Lulu towel set😀", "quibri travel MUG", "栖岚芽" + "x" * 20_000 + "Lulu towel set"]


def test_contained_terms(spark, tmp_path):
    ship_package(spark)
    terms = lk.known_terms(spark.createDataFrame([(t,) for t in TRACES], "trace string"), "trace")
    want = {("title", "栖岚加厚瑜伽垫"), ("brand", "栖岚芽"), ("title", "Quibri travel mug"), ("brand", "Quibri"), ("title", "Lulu towel set"), ("option", "墨绿色加大款")}
    assert {tuple(r) for r in terms.collect()} == want
    texts = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "k bigint, text string")
    got = [tuple(r) for r in lk.copied(texts, "k", "text", terms).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, k, t) for i, x in enumerate(TEXTS) for k, t in want if t in x}


def test_query_reports_planted_lines(spark, tmp_path):
    ledger = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "see task-000874", "id 12345678901", "the ASIN here", "id A1234567890", None])], "ledger_row bigint, content string")
    ledger.write.parquet(f"{tmp_path}/proposal_ledger.parquet")
    spark.createDataFrame([(t,) for t in TRACES], "trace string").write.parquet(f"{tmp_path}/traces.parquet")
    rows = {r.ledger_row: {k for k, v in r.asDict().items() if v is True} for r in entry.queries()["leakage_known"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(TEXTS) + 4
    assert rows == {0: {"copies_title"}, 1: {"copies_title", "copies_brand"}, 2: {"copies_option"}, 3: set(), 4: set(), 5: {"copies_title"}, 6: set(), 7: {"copies_title", "copies_brand"}, 8: {"task_id"}, 9: {"long_identifier"}, 10: {"mentions_asin"}, 11: set()}
