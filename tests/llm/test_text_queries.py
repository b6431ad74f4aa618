"""The registered text queries over the whole smallest tables, against brute force."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def test_p1(spark, small):
    rows = spark.read.parquet(f"{small}/proposal_ledger.parquet").select("batch_no", "ledger_row", "candidate_id", "replacement_family_id", "content").collect()
    assert {r[0] for r in entry.queries()["p1_found"](spark, small).collect()} == brute.refused([tuple(r) for r in rows])


def test_p5(spark, small):
    led = spark.read.parquet(f"{small}/proposal_ledger.parquet").select("candidate_id", "content", "failure_mechanism").collect()
    pool = spark.read.parquet(f"{small}/candidate_pool.parquet").selectExpr("coalesce(skill_id, candidate_id)", "content").collect()
    want = {("proposal_ledger.content", *p) for p in brute.like_pairs([(r[0], r[1]) for r in led])}
    want |= {("proposal_ledger.failure_mechanism", *p) for p in brute.like_pairs([(r[0], r[2]) for r in led])}
    want |= {("candidate_pool.content", *p) for p in brute.like_pairs([tuple(r) for r in pool])}
    df = entry.queries()["p5_found"](spark, small)
    assert {tuple(r) for r in df.select("field_name", "id_a", "id_b").collect()} == want
    groups = entry.queries()["p5_groups"](spark, small)
    assert groups.where("links > 0").count() > 0


def test_p7_p8_p9(spark, small):
    q = entry.queries()
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text <> ''").count()
    placed = q["p7_placed"](spark, small)
    assert placed.select("pack_name", "doc_id").distinct().count() == 3 * docs
    assert q["p7_report"](spark, small).where("unused_share > 0.2").count() == 0
    shares = {r.source: r for r in q["p8_shares"](spark, small).collect()}
    assert all(r.most_repeats <= r.max_repeats for r in shares.values())
    assert q["p8_chosen"](spark, small).count() > 0
    assert 0 < q["p9_found"](spark, small).count() < 0.2 * docs
    assert q["p9_kinds"](spark, small).count() > 0
