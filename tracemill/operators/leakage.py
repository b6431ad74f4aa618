"""Texts that copy a product title, brand or gold option known from traces.

Method: a term's anchor is the smallest hash among its runs of GRAM characters; a text
offers the hashes of all its runs. Anchor and runs meet in an equality join, and whole
terms are then looked for in whole texts. Neither side is gathered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("title", "brand", "option")
#: Shortest terms by kind, in characters without surrounding blanks (the reference's).
LEAST = {"title": 6, "brand": 3, "option": 6}
#: Characters of a run: no term is shorter.
GRAM = min(LEAST.values())


def _dict(v) -> dict:
    return v if isinstance(v, dict) else {}


def terms_of(trace: str | None) -> list[tuple[str, str]]:
    """(kind, term) of one trace; torn traces have none. Steps are a list, or one record for a single step."""
    try:
        record = _dict(json.loads(trace or ""))
    except ValueError:
        return []
    final, steps = _dict(record.get("final")), record.get("steps")
    goal, out = _dict(final.get("goal")), []
    for r in (goal, _dict(final.get("purchase"))):
        out.append(("title", r.get("name") or r.get("title")))
    for step in steps if isinstance(steps, list) else [steps]:
        product = _dict(_dict(_dict(_dict(step).get("environment")).get("observation_state")).get("product"))
        out += [("title", product.get("title")), ("brand", product.get("brand"))]
    options = goal.get("goal_options")
    out += [("option", x) for x in options] if isinstance(options, list) else []
    return sorted({(k, v.strip()) for k, v in out if isinstance(v, str) and len(v.strip()) >= LEAST[k]})


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("term", T.StringType())])))
def _terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for traces in batches:
        yield traces.map(lambda t: [{"kind": k, "term": v} for k, v in terms_of(t)])


def known_terms(traces: DataFrame, trace: str) -> DataFrame:
    """Distinct (kind, term) of all traces."""
    return traces.where(F.col(trace).isNotNull()).select(F.inline(_terms(F.col(trace)))).distinct()


@F.pandas_udf(T.ArrayType(T.LongType()))
def _runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Distinct runs of a text as numbers: the code points, 21 bits each, so that equal numbers are equal runs."""
    for texts in batches:
        yield texts.map(lambda t: sorted({(ord(a) << 42) | (ord(b) << 21) | ord(c) for a, b, c in zip(t, t[1:], t[2:])}))


def copied(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, kind, term): the terms that a text contains. ``key`` need not be unique."""
    anchor: Column = F.array_min(F.transform(_runs(F.col("term")), lambda r: F.struct(F.xxhash64(r).alias("h"), r.alias("run"))))["run"]
    known = terms.select("kind", "term", anchor.alias("_run"))
    whole = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    offers = whole.select(key, F.explode(_runs(F.col("_text"))).alias("_run"))
    # Many times the texts' own rows, which the optimizer can't see: never broadcast, and without the texts.
    met = offers.hint("merge").join(known, "_run").select(key, "kind", "term").distinct()
    return met.join(whole, key).where(F.contains("_text", "term")).select(key, "kind", "term").distinct()
