"""Search over documents with the full tokenizer: block scores equal the joined ones; Han text is found."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracemill.operators import retrieval as rt


def ranks(df):
    return {(r.query_id, r.hit_rank): (r.doc, pytest.approx(r.score, abs=2e-6)) for r in df.collect()}


def test_blocks_equal_the_joined_scores(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").limit(60).union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "杯")], "doc_id bigint, text string").join(spark.range(1).select(*(F.lit(None).alias(c) for c in ("lang", "source", "n_chars", "chunk_id", "round_id", "created_at")))).select("doc_id", "text", "lang", "source", "n_chars", "chunk_id", "round_id", "created_at"))
    q = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), F.explode(rt.search_tokens(F.col("text"))).alias("term"))
    want = rt.bm25(d, "doc_id", {"text": 1.0}, q, 10, rt.search_tokens)
    got = rt.bm25_blocks(d, "doc_id", "text", q, 10, rows=16, sets=4)
    assert {(r.query_id, r.hit_rank): r.doc for r in want.collect()} and ranks(got) == ranks(want)


def test_every_twentieth_document_finds_itself(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    asked = {r[0] for r in d.where("doc_id % 20 = 0 and size(array_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[一-龥]', 0))) > 0").select("doc_id").collect()}
    hits = entry.queries()["bm25_documents_han"](spark, small).collect()
    assert {r.query_id for r in hits} == asked and {r.query_id for r in hits if r.doc == r.query_id} == asked
