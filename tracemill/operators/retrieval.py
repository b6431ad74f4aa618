"""Text and vector retrieval: tokens, BM25 over weighted fields, dense top-k, rank metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import normal_query
from tracemill.session import written

#: BM25 constants and the floor of the inverse document frequency (fixed values).
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def latin_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))


def search_tokens(text: Column) -> Column:
    """Distinct tokens of a normal query: Han pairs (a Han character that stands alone by itself), then Latin words and numbers, joined by . _ + - / as they are written."""
    low = normal_query(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(r"([\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+)"), F.lit(1))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2))))
    latin = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+(?:[._+\-/][a-z0-9]+)*"), F.lit(0))
    return F.array_distinct(F.concat(F.flatten(F.transform(runs, pairs)), latin))


def postings(docs: DataFrame, doc: str, fields: dict[str, float], tokens=latin_tokens) -> tuple[DataFrame, DataFrame]:
    """(postings: term, doc, f; sizes: doc, size): weighted term counts, and tokens over all fields."""
    cols = [F.struct(F.lit(float(w)).alias("w"), tokens(F.col(c)).alias("t")) for c, w in fields.items()]
    each = docs.select(F.col(doc).alias("doc"), F.array(*cols).alias("f"))
    sizes = each.select("doc", F.aggregate("f", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["t"])).alias("size"))
    terms = each.select("doc", F.inline("f")).select("doc", "w", F.explode("t").alias("term"))
    return terms.groupBy("term", "doc").agg(F.sum("w").alias("f")), sizes


def bm25(docs: DataFrame, doc: str, fields: dict[str, float], queries: DataFrame, k: int, tokens=latin_tokens) -> DataFrame:
    """query_id, doc, score, hit_rank: the k best documents of each query; ties by doc.

    ``queries`` has query_id, term; a query's terms are gathered, a few words each.
    Queries with the same terms are scored once. Only postings of query terms are kept, by
    a join on the term. Scores are rounded to six digits before ranking, so that ties are
    ties.
    """
    post, sizes = postings(docs, doc, fields, tokens)
    stats = sizes.agg(F.count("*").alias("docs"), F.avg("size").alias("mean_size"))
    sets = queries.where("term is not null").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms")).withColumn("set_id", F.sha2(F.to_json("terms"), 256))
    asked = sets.groupBy("set_id").agg(F.first("terms").alias("terms")).select("set_id", F.explode("terms").alias("term"))
    hits = post.join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("n"))
    scored = hits.join(df, "term").join(sizes, "doc").crossJoin(stats)  # one row
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    part = F.when(idf > 0, idf).otherwise(IDF_FLOOR) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    total = scored.select("term", "doc", part.alias("part")).join(asked, "term").groupBy("set_id", "doc").agg(F.round(F.sum("part"), 6).alias("score"))
    w = Window.partitionBy("set_id").orderBy(F.desc("score"), "doc")
    best = total.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= k)
    return best.join(sets.select("query_id", "set_id"), "set_id").select("query_id", "doc", "score", "hit_rank")


def bm25_blocks(docs: DataFrame, doc: str, text: str, queries: DataFrame, k: int, tokens=search_tokens, rows: int = 8192, sets: int = 2048) -> DataFrame:
    """As ``bm25`` over one field, for many long queries: no row per (query, document, term) is made.

    Documents and distinct queries are dealt into blocks; a pair of blocks is scored from
    the document block's postings, one query's sums at a time, and a query keeps its k
    best of each. Terms are compared by their xxhash64.
    """
    spark, ids = docs.sparkSession, lambda c: F.transform(c, lambda t: F.xxhash64(t))
    each = written(docs.select(F.col(doc).cast("bigint").alias("doc"), ids(tokens(F.col(text))).alias("t")), "tokens")
    count = each.count()
    n_docs = max(1, -(-count // rows))
    asked = queries.where("term is not null").groupBy("query_id").agg(F.array_sort(F.collect_set(F.xxhash64("term"))).alias("t"))
    asked = written(asked.withColumn("set_id", F.sha2(F.to_json("t"), 256)), "asked")
    terms = asked.groupBy("set_id").agg(F.first("t").alias("t")).select("set_id", F.explode("t").alias("term"))
    n = each.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log((F.lit(count) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    terms = terms.join(n, "term").withColumn("idf", F.when(idf > 0, idf).otherwise(IDF_FLOOR))
    one = written(terms.groupBy("set_id").agg(F.collect_list(F.struct("term", "idf")).alias("w")).select("set_id", "w.term", "w.idf"), "sets")
    n_sets = max(1, -(-one.count() // sets))
    mean = each.agg(F.avg(F.size("t"))).first()[0] or 1.0
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    over = lambda m, name: spark.range(m).select(F.col("id").cast("int").alias(name))
    left = one.withColumn("q_block", part("set_id", n_sets)).crossJoin(over(n_docs, "d_block"))
    right = each.where("doc is not null").withColumn("d_block", part("doc", n_docs)).crossJoin(over(n_sets, "q_block"))
    near = left.groupBy("q_block", "d_block").cogroup(right.groupBy("q_block", "d_block")).applyInPandas(lambda key, q, d: _block_best(q, d, mean, k), "set_id string, doc bigint, score double")
    w = Window.partitionBy("set_id").orderBy(F.desc("score"), "doc")
    best = near.withColumn("hit_rank", F.row_number().over(w).cast("bigint")).where(F.col("hit_rank") <= k)
    return best.join(asked.select("query_id", "set_id"), "set_id").select("query_id", "doc", "score", "hit_rank")


def _block_best(q: pd.DataFrame, d: pd.DataFrame, mean: float, k: int) -> pd.DataFrame:
    """The k best documents of a block for each query of a block."""
    got: list[tuple] = []
    if len(q) and len(d):
        ids, sizes = d["doc"].to_numpy(), d["t"].map(len).to_numpy()
        term, at = np.concatenate(d["t"].to_numpy()).astype(np.int64), np.repeat(np.arange(len(d)), sizes)
        order = np.lexsort((at, term))
        term, at = term[order], at[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (at[1:] != at[:-1])]) if len(term) else np.zeros(0, int)
        f = np.diff(np.r_[first, len(term)])
        term, at = term[first], at[first]
        part = f * (K1 + 1) / (f + K1 * (1 - B + B * sizes[at] / mean))
        for set_id, terms, idf in zip(q["set_id"], q["term"], q["idf"], strict=True):
            lo, hi = np.searchsorted(term, terms, "left"), np.searchsorted(term, terms, "right")
            spans = [slice(a, b) for a, b in zip(lo, hi, strict=True) if a < b]
            if not spans:
                continue
            weight = np.concatenate([part[s] for s in spans]) * np.repeat(np.asarray(idf), hi - lo)
            total = np.bincount(np.concatenate([at[s] for s in spans]), weight, len(d))
            hits = np.flatnonzero(total > 0)
            score = np.round(total[hits], 6)
            if len(hits) > k:
                keep = score >= np.partition(score, len(hits) - k)[len(hits) - k]
                hits, score = hits[keep], score[keep]
            top = np.lexsort((ids[hits], -score))[:k]
            got.append((np.full(len(top), set_id, dtype=object), ids[hits[top]], score[top]))
    out = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("set_id", "doc", "score"), out, strict=True)))


def dense_top(df: DataFrame, key: str, vector: str, is_query: Column, k: int, block: int = 4096) -> DataFrame:
    """query_id, hit_id, score, hit_rank by inner product, without the query itself; ties by id.

    Queries are dealt into blocks of at most ``block`` and base rows into partitions as
    they come; every (block, batch) is one matrix product of which a query keeps its k
    best. The queries travel as block rows joined to the base, so no side has to fit
    into one executor.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    n = max(1, -(-df.where(is_query).count() // block))
    q = df.where(is_query).select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    parts = max(1, -(-df.count() // 50_000))
    base = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).crossJoin(df.sparkSession.range(n).select(F.col("id").cast("int").alias("block")))
    copies = q.crossJoin(df.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")))

    def best(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "hit_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        a, b = np.stack(left["v"].to_numpy()).astype(float), np.stack(right["v"].to_numpy()).astype(float)
        ids, out = right["id"].to_numpy(), []
        for at in range(0, len(a), 256):
            s = np.round(a[at : at + 256] @ b.T, 5) + 0.0
            for i, row in enumerate(s):
                me = left["id"].iloc[at + i]
                row = np.where(ids == me, -np.inf, row)
                top = np.lexsort((ids, -row))[:k]
                out += [(me, ids[j], row[j]) for j in top if row[j] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "hit_id", "score"])

    near = copies.groupBy("block", "part").cogroup(base.groupBy("block", "part")).applyInPandas(best, "query_id bigint, hit_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id")
    return near.withColumn("hit_rank", F.row_number().over(w).cast("bigint")).where(F.col("hit_rank") <= k)


def rank_metrics(ranks: DataFrame, rank: str, by: list[str]) -> DataFrame:
    """recall at 1, at 20, at all, and mean reciprocal rank; no rank counts as a miss."""
    hit = lambda k: F.round(F.avg(F.coalesce((F.col(rank) <= k).cast("int"), F.lit(0))), 6)
    return ranks.groupBy(*by).agg(F.count("*").alias("queries"), hit(1).alias("recall_1"), hit(20).alias("recall_20"), hit(10**9).alias("recall_all"), F.round(F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))), 6).alias("mrr"))
