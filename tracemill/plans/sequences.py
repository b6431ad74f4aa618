"""Queries of sequence arithmetic, over embeddings as pairs of log-probabilities and over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.common import array_sum, r6, ratio
from tracemill.operators import seqmath as sm
from tracemill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: A row's first and second half are the new and old log-probabilities; the mask is every third position left out.
_PAIR = """pq as (select vec_id, label, list_transform(embedding[1:32], lambda x: x::double) as n, list_transform(embedding[33:64], lambda x: x::double) as o,
 list_transform(range(32), lambda i: (i % 3 <> vec_id % 3)::int) as m from embeddings),
tk as (select vec_id, unnest(n) as n, unnest(o) as o, unnest(m) as m, unnest(range(32)) as i from pq)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (i % 3 != F.col("vec_id") % 3).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 32).alias("n"), F.slice("embedding", 33, 32).alias("o"), mask.alias("m"))


@query(f"""with {_PAIR} select vec_id, round(avg(n - o) filter (m = 1), 6) as k1, round(avg((o - n) * (o - n) / 2) filter (m = 1), 6) as k2,
round(avg(exp(o - n) - (o - n) - 1) filter (m = 1), 6) as k3, round(avg(greatest(-10, least(10, exp(greatest(-10, least(10, o - n))) - greatest(-10, least(10, o - n)) - 1))) filter (m = 1), 6) as low from tk group by 1""")
def kl_estimators(spark, sf):
    p = _pairs(spark, sf)
    return p.select("vec_id", *(r6(sm.masked_mean(sm.divergence(F.col("n"), F.col("o"), k), F.col("m"))).alias(k) for k in ("k1", "k2", "k3", "low")))


@query(f"""with {_PAIR}, s as (select *, sum(case when m = 1 then n - o else 0 end) over (partition by vec_id) as total, avg(case when m = 1 then n - o end) over (partition by vec_id) as mean from tk)
select vec_id, round(avg(least(exp(n - o), 1.2)) filter (m = 1), 6) as token_truncated, round(avg(greatest(0.8, least(1.2, exp(total)))) filter (m = 1), 6) as sequence_clipped,
round(avg(case when exp(mean) < 0.95 or exp(mean) > 1.05 then 0 else exp(mean) end) filter (m = 1), 6) as geometric_masked from s group by 1""")
def importance_weights(spark, sf):
    n, o, m = F.col("n"), F.col("o"), F.col("m")
    mean = lambda w, name: r6(sm.masked_mean(w, m)).alias(name)
    return _pairs(spark, sf).select(
        "vec_id",
        mean(sm.importance_weights(n, o, m, "token", 0, 1.2, "truncate"), "token_truncated"),
        mean(sm.importance_weights(n, o, m, "sequence", 0.8, 1.2, "clip"), "sequence_clipped"),
        mean(sm.importance_weights(n, o, m, "geometric", 0.95, 1.05, "mask"), "geometric_masked"),
    )


@query(f"""with {_PAIR}, r as (select vec_id, exp(avg(n - o) filter (m = 1)) as ratio, (label - 4.5) as adv from tk join (select vec_id as v, label from embeddings) on v = vec_id group by vec_id, label)
select vec_id, round(greatest(-adv * ratio, -adv * greatest(0.98, least(1.02, ratio))), 6) as loss,
round(case when adv < 0 then least(greatest(-adv * ratio, -adv * greatest(0.98, least(1.02, ratio))), -adv * 1.01) else greatest(-adv * ratio, -adv * greatest(0.98, least(1.02, ratio))) end, 6) as dual_loss from r""")
def clipped_objectives(spark, sf):
    p = _pairs(spark, sf).select("vec_id", (F.col("label") - 4.5).alias("adv"), F.exp(sm.masked_mean(F.zip_with("n", "o", lambda a, b: a.cast("double") - b.cast("double")), F.col("m"))).alias("ratio"))
    a, r = F.col("adv"), F.col("ratio")
    return p.select("vec_id", r6(sm.clipped_objective(r, a, 0.02, 0.02)).alias("loss"), r6(sm.clipped_objective(r, a, 0.02, 0.02, 1.01)).alias("dual_loss"))


@query(f"""with {_PAIR} select vec_id, round(avg((i + vec_id) % 5 + 1) filter (m = 1), 6) as kept from tk group by 1""")
def ragged_kept_per_token(spark, sf):
    lengths = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (i + F.col("vec_id")) % 5 + 1)
    offsets = F.aggregate(lengths, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    return _pairs(spark, sf).withColumn("off", offsets).select("vec_id", r6(sm.ragged_kept(F.col("off"), F.col("m"))).alias("kept"))


@query(f"""with {_PAIR} select vec_id, coalesce(len(m) - nullif(list_position(m, 1), 0) + 1, 0)::int as response_length, list_sum(m)::bigint as trainable from pq""")
def turn_mask_stats(spark, sf):
    return _pairs(spark, sf).select("vec_id", sm.response_length(F.col("m")).alias("response_length"), F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("trainable"))


@query(f"""with {_PAIR}, b as (select vec_id, list_transform(n, lambda x: (x > 0)::int) as s, list_transform(o, lambda x: (x > 0)::int) as t from pq)
select vec_id, coalesce(list_sum(list_transform(range(0, 30), lambda i: (s[i + 1] = 1 and s[i + 2] = 0 and s[i + 3] = 1)::int)), 0)::int as hits,
coalesce(list_min(list_filter(range(0, 32), lambda i: s[i + 1] <> t[i + 1])), 32)::int as prefix from b""")
def sublist_positions(spark, sf):
    sign = lambda c: F.transform(c, lambda x: (x > 0).cast("int"))
    b = _pairs(spark, sf).select("vec_id", sign("n").alias("s"), sign("o").alias("t"))
    return b.select("vec_id", F.size(sm.sublist_positions(F.col("s"), F.array(F.lit(1), F.lit(0), F.lit(1)))).alias("hits"), sm.common_prefix(F.col("s"), F.col("t")).alias("prefix"))


@query(f"""with {_PAIR} select vec_id, len(embedding[greatest(2, 64 - (vec_id % 70) + 1):64])::int as kept, round(list_sum(list_transform(embedding[greatest(2, 64 - (vec_id % 70) + 1):64], lambda x: x::double)), 6) as total
from embeddings where vec_id % 70 > 0""")
def tail_slices(spark, sf):
    tail = sm.tail_slice(F.col("embedding"), (F.col("vec_id") % 70).cast("int"))
    return table(spark, sf, "embeddings").where("vec_id % 70 > 0").select("vec_id", F.size(tail).alias("kept"), r6(array_sum(tail)).alias("total"))


@query("""with m as (select max(n_chars) as longest from documents), q as (select case when n_chars <= 20000 then greatest(ceil(n_chars * 4 / 20000), 1)::int end as quarter from documents)
select quarter, count(*)::bigint as n, round(count(*) / (sum(count(*)) over () + 1e-9), 6) as share from q group by 1""")
def length_quartiles(spark, sf):
    q = table(spark, sf, "documents").select(sm.length_quarter(F.col("n_chars"), F.lit(20000)).alias("quarter")).groupBy("quarter").agg(F.count("*").alias("n"))
    return q.withColumn("share", r6(F.col("n") / (F.sum("n").over(Window.partitionBy()) + 1e-9)))


@query("""select doc_id, (n_chars::double * (12 * (8.0 * 256 * 256 + 6.0 * 256 * 1024) + 2.0 * 256 * 32000) + 4.0 * 12 * 256 * n_chars::double * n_chars) as flops from documents""")
def flops_by_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sm.forward_flops(F.col("n_chars"), 12, 256, 1024, 32000).alias("flops"))


@query("""with s as (select source, n_chars, max(n_chars) over (partition by source) as longest from documents where source is not null)
select source, round(avg(n_chars), 6) as mean_length, median(n_chars) as median_length, round(avg((n_chars > 2000)::int), 6) as long_share, count(*) filter (n_chars = longest)::bigint as longest_ties from s group by 1""")
def throughput_longest_ties(spark, sf):
    """Length figures per source, and how many documents share the longest length; the maximum is joined, not windowed over a hot source."""
    d = table(spark, sf, "documents").where("source is not null").select("source", "n_chars")
    counts = d.groupBy("source", "n_chars").agg(F.count("*").alias("ties"))
    top = counts.groupBy("source").agg(F.max_by("ties", "n_chars").alias("longest_ties"))
    a = d.groupBy("source").agg(r6(F.avg("n_chars")).alias("mean_length"), F.median("n_chars").alias("median_length"), r6(F.avg((F.col("n_chars") > 2000).cast("int"))).alias("long_share"))
    return a.join(top, "source")


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0), s as (select q.vec_id as query_id, e.vec_id as hit_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::double * z[2]::double)) as score
from q cross join embeddings e where e.vec_id <> q.vec_id)
select query_id, hit_id, round(score, 5) as score, row_number() over (partition by query_id order by round(score, 5) desc, hit_id) as hit_rank from s qualify hit_rank <= 10""")
def dense_topk(spark, sf):
    """The ten nearest by inner product for every vector whose id is divisible by 20, against all rows, in blocks.

    Each block of base rows keeps its own ten for a query before anything is
    shuffled, so a query's candidates are ten per block, not all rows.
    """
    from tracemill.operators.retrieval import dense_top

    return dense_top(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10)
