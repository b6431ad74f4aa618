"""Queries over arms, groups and treatments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.common import global_rank, hash_bits, hash_number, hash_uniform, nearest_rank, r6, ratio, sem
from tracemill.operators import experiment as ex
from tracemill.operators import groups as gr
from tracemill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_HASH = "substr(sha256(concat_ws(':', {})), 1, 16)"
_UNI = "(('0x' || substr(sha256(concat_ws(':', {})), 1, 13))::bigint::double / 4503599627370496.0)"
#: A group is a part, a rollout an order; returned lines are the good ones.
_ROLL = "ro as (select l_partkey, l_orderkey, min((l_returnflag = 'R')::int::double) as reward, min(l_extendedprice) as price from lineitem group by 1, 2)"
_GRP = f"{_ROLL}, gp as (select l_partkey, count(*)::bigint as n, sum(reward)::bigint as c, min(reward) as lo, max(reward) as hi, coalesce(stddev_samp(reward), 0) as dev from ro group by 1)"
_ARM = "arm as (select l_partkey, avg(l_extendedprice) filter (l_linestatus = 'F') as a, avg(l_extendedprice) filter (l_linestatus = 'O') as b from lineitem group by 1), pr as (select *, a - b as delta from arm where a is not null and b is not null)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def _rolls(spark, sf) -> DataFrame:
    return gr.rollouts(_lines(spark, sf), ["l_partkey"], "l_orderkey", (F.col("l_returnflag") == "R").cast("double"))


def _pairs(spark, sf) -> DataFrame:
    return ex.paired(_lines(spark, sf), "l_linestatus", "F", "O", "l_partkey", F.col("l_extendedprice"))


@query("select l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) as pooled, round(avg(l_extendedprice / l_quantity), 6) as mean_ratio from lineitem group by 1")
def pooled_vs_mean_ratio(spark, sf):
    from tracemill.operators.episodes import pooled_and_mean

    return pooled_and_mean(_lines(spark, sf), ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def pending_work(spark, sf):
    done = _lines(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query(f"with {_ARM} select l_partkey, round(a, 6) as a, round(b, 6) as b, round(delta, 6) as delta from pr")
def paired_arms(spark, sf):
    return _pairs(spark, sf).select("l_partkey", r6("a").alias("a"), r6("b").alias("b"), r6("delta").alias("delta"))


@query("""with s as (select l_partkey, max((l_returnflag = 'R')::int) filter (l_linestatus = 'F') as f, max((l_returnflag = 'R')::int) filter (l_linestatus = 'O') as o from lineitem group by 1)
select f || '->' || o as transition, count(*)::bigint as n from s where f is not null and o is not null group by 1""")
def success_transitions(spark, sf):
    good = (F.col("l_returnflag") == "R").cast("int")
    s = _lines(spark, sf).groupBy("l_partkey").agg(F.max(F.when(F.col("l_linestatus") == "F", good)).alias("f"), F.max(F.when(F.col("l_linestatus") == "O", good)).alias("o"))
    return s.where("f is not null and o is not null").groupBy(F.concat_ws("->", "f", "o").alias("transition")).agg(F.count("*").alias("n"))


@query(f"with {_ARM} select count(*)::bigint as n, round(avg(a), 4) as mean_a, round(avg(b), 4) as mean_b, round(avg(delta), 4) as mean_delta, round(stddev_samp(delta) / sqrt(count(delta)), 4) as sem_delta from pr")
def paired_means_sem(spark, sf):
    r4 = lambda c: F.round(c, 4)
    return _pairs(spark, sf).agg(F.count("*").alias("n"), r4(F.avg("a")).alias("mean_a"), r4(F.avg("b")).alias("mean_b"), r4(F.avg("delta")).alias("mean_delta"), r4(sem("delta")).alias("sem_delta"))


@query(f"""with d as (select ({_HASH.format("'7', l_orderkey, l_partkey, l_suppkey, 'x1'")} < '8000000000000000')::int::double as x1, ({_HASH.format("'7', l_orderkey, l_partkey, l_suppkey, 'x2'")} < '8000000000000000')::int::double as x2, l_quantity as y from lineitem),
g as (select sum(x1 * x1) as a, sum(x1 * x2) as b, sum(x2 * x2) as c, sum(x1 * y) as p, sum(x2 * y) as q, count(*)::bigint as n from d)
select 'x1' as factor, round((p * c - q * b) / (a * c - b * b), 6) as coefficient, n from g union all select 'x2', round((q * a - p * b) / (a * c - b * b), 6), n from g""")
def ols_no_intercept_2(spark, sf):
    parts = lambda x: (F.lit("7"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.lit(x))
    d = _lines(spark, sf).select(ex.bernoulli(*parts("x1")).alias("x1"), ex.bernoulli(*parts("x2")).alias("x2"), F.col("l_quantity").alias("y"))
    return ex.ols_no_intercept(d, ["x1", "x2"], "y").withColumn("coefficient", r6("coefficient"))


@query(f"select c_custkey, r_regionkey, ({_HASH.format("'42', c_custkey, r_name")} < '8000000000000000')::int as included from customer cross join region")
def bernoulli_masks(spark, sf):
    """Jobs by chunks: five regions stand for the frozen chunks."""
    chunks = table(spark, sf, "region").select("r_regionkey", "r_name")
    jobs = table(spark, sf, "customer").select("c_custkey")
    return jobs.crossJoin(chunks).select("c_custkey", "r_regionkey", ex.bernoulli(F.lit("42"), F.col("c_custkey"), F.col("r_name")).alias("included"))


@query(f"select c_custkey, r_regionkey, (('0x' || {_HASH.format("'9', c_custkey, r_name")})::ubigint % 4)::int as slot from customer cross join region")
def slot_assignment(spark, sf):
    chunks = table(spark, sf, "region").select("r_regionkey", "r_name")
    return table(spark, sf, "customer").select("c_custkey").crossJoin(chunks).select("c_custkey", "r_regionkey", ex.slot_of(3, F.lit("9"), F.col("c_custkey"), F.col("r_name")).alias("slot"))


@query("select s_suppkey, round(greatest(0.1, least(0.9, 0.1 + 0.8 * s_acctbal / max(case when s_acctbal > 0 then s_acctbal end) over ())), 6) as probability from supplier")
def inclusion_probability(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", r6(ex.inclusion_probability(table(spark, sf, "supplier"), "s_acctbal")).alias("probability"))


@query("select skill_id, round(greatest(0.1, least(0.9, 0.1 + 0.8 * contribution / max(case when contribution > 0 then contribution end) over ())), 6) as probability from curriculum")
def curriculum_probability(spark, sf):
    return table(spark, sf, "curriculum").select("skill_id", r6(ex.inclusion_probability(table(spark, sf, "curriculum"), "contribution")).alias("probability"))


@query(f"""with g as (select o_orderkey, {_UNI.format("'s1', o_orderkey, 'free'")} < 0.25 as is_free from orders),
d as (select o_orderkey, is_free, r_name from g left join region on not is_free and {_UNI.format("'s1', o_orderkey, r_name")} < 0.2 + 0.1 * r_regionkey)
select o_orderkey, case when any_value(is_free) then 'free' when count(r_name) = 0 then 'empty' else 'assisted' end as mode, coalesce(string_agg(r_name, ',' order by r_name), '') as ids from d group by 1""")
def group_treatment(spark, sf):
    chunks = table(spark, sf, "region").select(F.col("r_name").alias("chunk_id"), (0.2 + 0.1 * F.col("r_regionkey")).alias("probability"))
    t = ex.group_treatment(table(spark, sf, "orders"), chunks, "o_orderkey", "s1", 0.25)
    return t.select("o_orderkey", "mode", F.array_join("ids", ",").alias("ids"))


_EFFECT = "(p_retailprice % 7) - 3"


@query(f"""with e as (select p_partkey, p_brand, round({_EFFECT}, 4) as effect, p_size <= 10 as is_old from part),
w as (select * from e qualify row_number() over (partition by p_brand order by effect desc, is_old desc, p_partkey) = 1),
r as (select *, row_number() over (order by effect desc, p_partkey) as effect_rank from w)
select p_brand, p_partkey, effect, effect_rank::bigint as effect_rank, case when effect <= 0 then 'rejected' when effect_rank <= 8 then 'selected' else 'reserve' end as status from r""")
def family_winner_topk(spark, sf):
    e = table(spark, sf, "part").select("p_partkey", "p_brand", F.round(F.expr(_EFFECT), 4).alias("effect"), "p_size")
    w = ex.family_winners(e, "p_brand", "effect", F.col("p_size") <= 10, "p_partkey")
    return ex.top_positive(w, "effect", "p_partkey", 8).select("p_brand", "p_partkey", "effect", F.col("effect_rank").cast("bigint").alias("effect_rank"), "status")


@query(f"with {_ROLL} select l_partkey, l_orderkey, round((reward - avg(reward) over w) / (coalesce(stddev_samp(reward) over w, 0) + 1e-6), 4) as advantage from ro window w as (partition by l_partkey)")
def grpo_advantage(spark, sf):
    return gr.advantages(_rolls(spark, sf), ["l_partkey"]).select("l_partkey", "l_orderkey", F.round("advantage", 4).alias("advantage"))


@query(f"""with {_ROLL}, v as (select *, case when price between 1000 and 80000 then price end as ok from ro),
s as (select *, avg(ok) over (partition by l_partkey) as m, stddev_pop(ok) over (partition by l_partkey) as d from v)
select l_partkey, l_orderkey, round(case when ok is null then price when d <= 1e-6 then 0 else (ok - m) / d end, 4) as z from s""")
def valid_range_zscore(spark, sf):
    r = gr.rollouts(_lines(spark, sf), ["l_partkey"], "l_orderkey", F.col("l_extendedprice"))
    return gr.valid_zscore(r, ["l_partkey"], 1000, 80000).select("l_partkey", "l_orderkey", F.round("z", 4).alias("z"))


@query("""with g as (select avg(l_extendedprice) as m, var_samp(l_extendedprice) as v from lineitem where l_linestatus = 'F')
select l_orderkey, l_partkey, l_suppkey, round((l_extendedprice - m) / sqrt(v + 1e-8), 6) as white from lineitem cross join g""")
def masked_whitening(spark, sf):
    d = _lines(spark, sf).withColumn("mask", (F.col("l_linestatus") == "F").cast("int"))
    return gr.whitened(d, "l_extendedprice", "mask").select("l_orderkey", "l_partkey", "l_suppkey", r6("white").alias("white"))


@query(f"with {_GRP} select l_partkey, n as size, round(dev, 6) as deviation, n >= 2 and hi - lo > 1e-6 and dev > 1e-6 as keep from gp")
def group_admission(spark, sf):
    return gr.admission(_rolls(spark, sf), ["l_partkey"]).select("l_partkey", "size", r6("deviation").alias("deviation"), "keep")


@query(f"with {_GRP} select round_even(lo, 1) as label, count(*)::bigint as n from gp where lo = hi group by 1")
def zero_std_labels(spark, sf):
    g = _rolls(spark, sf).groupBy("l_partkey").agg(F.min("reward").alias("lo"), F.max("reward").alias("hi"))
    return g.where("lo = hi").groupBy(F.bround("lo", 1).alias("label")).agg(F.count("*").alias("n"))


@query(f"""with {_GRP}, p as (select unnest([1, 2, 4]) as k), j as (select k, case when c = 0 then 0.0 when n - c < k then 1.0 else 1 - list_reduce(list_transform(generate_series(n - c + 1, n), lambda i: 1 - k::double / i), lambda a, b: a * b) end as v from gp cross join p)
select k, round(avg(v), 6) as pass_at_k from j group by 1""")
def pass_at_k(spark, sf):
    g = _rolls(spark, sf).groupBy("l_partkey").agg(F.count("*").cast("int").alias("n"), F.sum("reward").cast("int").alias("c"))
    one = g.agg(*(F.avg(gr.pass_at_k(F.col("n"), F.col("c"), k)).alias(str(k)) for k in (1, 2, 4)))
    return one.unpivot([], ["1", "2", "4"], "k", "v").select(F.col("k").cast("int").alias("k"), r6("v").alias("pass_at_k"))


@query("""select l_orderkey, round(sum(l_quantity * (l_returnflag <> 'N')::int) / greatest(sum((l_returnflag <> 'N')::int), 1), 6) as mean from lineitem group by 1""")
def token_weighted_mean(spark, sf):
    d = _lines(spark, sf).withColumn("mask", (F.col("l_returnflag") != "N").cast("int"))
    return gr.token_weighted_mean(d, ["l_orderkey"], "l_quantity", "mask").withColumn("mean", r6("mean"))


@query("""with s as (select o_custkey, o_orderkey, (row_number() over (order by o_orderkey) - 1) // 64 as step from orders), n as (select count(*) // 64 as full from orders)
select o_orderkey, step::bigint as step from s cross join n where step < n.full""")
def step_assignment(spark, sf):
    """Steps of 64 orders in key order; the incomplete tail is dropped. Ranks come from range counts, not one sorted task."""
    o = table(spark, sf, "orders").select("o_orderkey")
    ranked = global_rank(o, "o_orderkey")
    full = o.count() // 64
    return ranked.select("o_orderkey", F.expr("cast((rank_no - 1) div 64 as bigint)").alias("step")).where(F.col("step") < full)


@query("""select l_suppkey, l[round_even((len(l) - 1) * 0.95, 0)::int + 1] as p95 from (select l_suppkey, list_sort(list(l_extendedprice)) as l from lineitem group by 1)""")
def nearest_rank_p95(spark, sf):
    """Nearest rank by running counts of distinct values, so that a hot key needs no list."""
    c = _lines(spark, sf).groupBy("l_suppkey", "l_extendedprice").agg(F.count("*").alias("c"))
    w = Window.partitionBy("l_suppkey")
    c = c.withColumn("upto", F.sum("c").over(w.orderBy("l_extendedprice"))).withColumn("n", F.sum("c").over(w))
    return c.where(F.col("upto") >= F.bround((F.col("n") - 1) * 0.95) + 1).groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("p95"))


@query(f"""with {_GRP} select l_partkey, n, c, case when c = n then 'all_correct' when c = 0 then 'all_wrong' when c * 2 > n then 'mostly_correct' else 'mixed' end as label from gp""")
def group_triage(spark, sf):
    g = _rolls(spark, sf).groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("reward").cast("bigint").alias("c"), F.count("reward").alias("s"))
    return g.select("l_partkey", "n", "c", gr.triage(F.col("n"), F.col("c"), F.col("s")).alias("label"))


@query("""select coalesce(a.k, b.k) as k, case when a.k is null then 'right' when b.k is null then 'left' else 'both' end as side
from (select distinct o_orderkey as k from orders where o_orderstatus = 'F') a full join (select distinct l_orderkey as k from lineitem where l_returnflag = 'R') b on a.k = b.k""")
def key_set_reconciliation(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    b = _lines(spark, sf).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return ex.key_sets(a, b, ["k"])


@query("""select l_partkey, round(avg(l_quantity) filter (l_returnflag = 'A'), 6) as arm_a, round(avg(l_quantity) filter (l_returnflag = 'N'), 6) as arm_n,
round(avg(l_quantity) filter (l_returnflag = 'R'), 6) as arm_r, count(distinct l_returnflag) = 3 as complete from lineitem group by 1""")
def four_arm_merge(spark, sf):
    arms = [r6(F.avg(F.when(F.col("l_returnflag") == a, F.col("l_quantity")))).alias(f"arm_{a.lower()}") for a in "ANR"]
    return _lines(spark, sf).groupBy("l_partkey").agg(*arms, (F.countDistinct("l_returnflag") == 3).alias("complete"))


@query("""with a as (select l_orderkey as k, sum(l_extendedprice) as local_total from lineitem where l_returnflag = 'R' group by 1), b as (select o_orderkey as k, o_totalprice as stated from orders)
select k, round(coalesce(a.local_total, 0), 4) as total, b.stated, a.k is not null as has_lines from b left join a using (k)""")
def upsert_ledger(spark, sf):
    """A ledger keeps every record; results update those that have any."""
    a = _lines(spark, sf).where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("t"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("stated"))
    return b.join(a, "k", "left").select("k", F.round(F.coalesce("t", F.lit(0.0)), 4).alias("total"), "stated", F.col("t").isNotNull().alias("has_lines"))


@query("""with m as (select l_returnflag, avg(l_quantity) as quantity, avg(l_tax) as tax, avg(l_discount) as discount from lineitem group by 1), u as (unpivot m on quantity, tax, discount into name metric value v)
select metric, round(max(v) - min(v), 6) as largest_gap from u group by 1""")
def metric_reconciliation(spark, sf):
    m = _lines(spark, sf).groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount"))
    return m.unpivot(["l_returnflag"], ["quantity", "tax", "discount"], "metric", "v").groupBy("metric").agg(r6(F.max("v") - F.min("v")).alias("largest_gap"))


@query(f"""with d as (select o_orderkey, r_name, {_UNI.format("'s1', o_orderkey, r_name")} < 0.2 + 0.1 * r_regionkey as drawn from orders cross join region where not {_UNI.format("'s1', o_orderkey, 'free'")} < 0.25)
select r_name, round(avg(drawn::int), 6) as rate from d group by 1""")
def inclusion_rates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey").where(~(hash_uniform(F.lit("s1"), F.col("o_orderkey"), F.lit("free")) < 0.25))
    d = o.crossJoin(table(spark, sf, "region").select("r_name", "r_regionkey"))
    drawn = hash_uniform(F.lit("s1"), F.col("o_orderkey"), F.col("r_name")) < 0.2 + 0.1 * F.col("r_regionkey")
    return d.groupBy("r_name").agg(r6(F.avg(drawn.cast("int"))).alias("rate"))


@query("""select l_returnflag, round(sum(l_discount) / sum(l_quantity), 6) as ratio_of_sums, round(avg(l_discount), 6) as mean_rate from lineitem group by 1""")
def ratio_vs_mean_cache(spark, sf):
    return _lines(spark, sf).groupBy("l_returnflag").agg(r6(ratio(F.sum("l_discount"), F.sum("l_quantity"))).alias("ratio_of_sums"), r6(F.avg("l_discount")).alias("mean_rate"))


@query("""with p as (select l_linestatus, l_returnflag, sum(l_quantity) as s, count(*) as c from lineitem group by 1, 2) select l_linestatus, round(sum(s) / sum(c), 6) as by_tuples, round(avg(s / c), 6) as by_means from p group by 1""")
def partial_final_mean(spark, sf):
    """Final mean from (sum, count) parts beside the mean of the parts' means."""
    p = _lines(spark, sf).groupBy("l_linestatus", "l_returnflag").agg(F.sum("l_quantity").alias("s"), F.count("*").alias("c"))
    return p.groupBy("l_linestatus").agg(r6(ratio(F.sum("s"), F.sum("c"))).alias("by_tuples"), r6(F.avg(ratio("s", "c"))).alias("by_means"))


@query("""with b as (select l_linestatus, l_suppkey, count(*)::bigint as n, avg(l_quantity) as reward, count(distinct l_orderkey)::double as spread from lineitem group by 1, 2)
select l_linestatus, sum(n)::bigint as n, round(sum(reward * n) / sum(n), 6) as reward, round(sum(spread * n) / sum(n), 6) as spread from b group by 1""")
def weighted_meta(spark, sf):
    b = _lines(spark, sf).groupBy("l_linestatus", "l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("reward"), F.countDistinct("l_orderkey").cast("double").alias("spread"))
    return gr.weighted_meta(b, ["l_linestatus"], "n", ["reward", "spread"])


@query(f"""select c_custkey, ('0x' || {_HASH.format("'17', c_custkey")})::ubigint::varchar as seed, round({_UNI.format("'17', c_custkey")}, 6) as u, row_number() over (order by {_HASH.format("'17', c_custkey")}, c_custkey) as draw
from customer order by draw limit 200""")
def hash_seeds_and_sampling(spark, sf):
    """Per-row seeds; a sample of 200 is the order by hash."""
    h = hash_bits(F.lit("17"), F.col("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", h.alias("h")).orderBy("h", "c_custkey").limit(200)
    return c.select("c_custkey", hash_number(F.lit("17"), F.col("c_custkey")).cast("string").alias("seed"), r6(hash_uniform(F.lit("17"), F.col("c_custkey"))).alias("u"), F.row_number().over(Window.orderBy("h", "c_custkey")).cast("bigint").alias("draw"))


@query("""select p_brand, string_agg(p_partkey::varchar, ',' order by p_size, p_partkey) as members, count(*)::bigint as versions from part where p_size <= 5 group by 1""")
def slot_layout(spark, sf):
    p = table(spark, sf, "part").where("p_size <= 5").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_size", "p_partkey"))).alias("m"))
    return p.select("p_brand", F.array_join(F.transform("m", lambda x: x["p_partkey"].cast("string")), ",").alias("members"), F.size("m").cast("bigint").alias("versions"))


@query(f"""with {_GRP}, u as (select count(distinct n) = 1 as even from gp), r as (select ro.*, u.even from ro cross join u)
select l_partkey, l_orderkey, round((reward - case when even then avg(reward) over (partition by l_partkey) else avg(reward) over () end), 6) as centred from r""")
def global_or_group_norm(spark, sf):
    """Equal groups are centred by group; otherwise all rollouts are one group."""
    r = _rolls(spark, sf)
    sizes = r.groupBy("l_partkey").count().agg((F.countDistinct("count") == 1).alias("even"))
    mean = r.agg(F.avg("reward").alias("all_mean"))
    own = F.avg("reward").over(Window.partitionBy("l_partkey"))
    d = r.withColumn("own", own).crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(mean))
    return d.select("l_partkey", "l_orderkey", r6(F.col("reward") - F.when(F.col("even"), F.col("own")).otherwise(F.col("all_mean"))).alias("centred"))


@query(f"with {_ARM}, s as (select 'largest_gain' as rule, l_partkey, delta, row_number() over (order by delta desc, l_partkey) as r from pr union all select 'largest_drop', l_partkey, delta, row_number() over (order by delta, l_partkey) from pr) select rule, l_partkey, round(delta, 6) as delta from s where r = 1")
def extreme_case_selection(spark, sf):
    p = _pairs(spark, sf)
    pick = lambda rule, sign: p.agg(F.max(F.struct((F.col("delta") * sign).alias("d"), (-F.col("l_partkey")).alias("id"))).alias("b")).select(F.lit(rule).alias("rule"), (-F.col("b.id")).alias("l_partkey"), r6(F.col("b.d") * sign).alias("delta"))
    return pick("largest_gain", 1).unionByName(pick("largest_drop", -1))


@query("""select l_orderkey, l_partkey, l_suppkey, round(case when l_returnflag = 'R' then l_quantity when l_returnflag = 'A' then l_quantity * 0.5 else -least(0.1 * l_linenumber, 0.6) end, 6) as scaled from lineitem""")
def outcome_scaled_reward(spark, sf):
    """Reward scaled by the final outcome; failures cost by their calls, capped."""
    q, f = F.col("l_quantity"), F.col("l_returnflag")
    scaled = F.when(f == "R", q).when(f == "A", q * 0.5).otherwise(-F.least(0.1 * F.col("l_linenumber"), F.lit(0.6)))
    return _lines(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", r6(scaled).alias("scaled"))


@query(f"with {_GRP}, d as (select gp.*, p_brand from gp join part on p_partkey = l_partkey) select p_brand, count(*)::bigint as groups, round(sum(c) / sum(n), 6) as mean_reward, round(avg(case when c = 0 then 0.0 when n - c < 1 then 1.0 else c::double / n end), 6) as pass_at_1 from d group by 1")
def eval_rollup_passk(spark, sf):
    g = _rolls(spark, sf).groupBy("l_partkey").agg(F.count("*").cast("int").alias("n"), F.sum("reward").cast("int").alias("c"))
    d = g.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return d.groupBy("p_brand").agg(F.count("*").alias("groups"), r6(ratio(F.sum("c"), F.sum("n"))).alias("mean_reward"), r6(F.avg(gr.pass_at_k(F.col("n"), F.col("c"), 1))).alias("pass_at_1"))


@query(f"with {_ARM} select case when delta > 0 then 'positive' when delta < 0 then 'negative' else 'zero' end as sign, count(*)::bigint as n, count(distinct l_partkey) = count(*) as constant_ids from pr group by 1")
def sign_control_and_constancy(spark, sf):
    sign = F.when(F.col("delta") > 0, "positive").when(F.col("delta") < 0, "negative").otherwise("zero")
    return _pairs(spark, sf).groupBy(sign.alias("sign")).agg(F.count("*").alias("n"), (F.countDistinct("l_partkey") == F.count("*")).alias("constant_ids"))


@query("""select l_suppkey, round(sum(l_quantity) filter (l_returnflag = 'A'), 4) as a, round(sum(l_quantity) filter (l_returnflag = 'N'), 4) as n, round(sum(l_quantity) filter (l_returnflag = 'R'), 4) as r from lineitem group by 1""")
def metric_pivot(spark, sf):
    p = _lines(spark, sf).groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 4))
    return p.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("""with f as (select p_partkey from part where p_size < 10), u as (select l_partkey as id from lineitem where l_returnflag = 'R' union all select o_custkey from orders where o_orderstatus = 'P')
select id, count(*)::bigint as n, bool_or(f.p_partkey is not null) as common from u left join f on f.p_partkey = u.id group by 1""")
def flatten_union(spark, sf):
    u = _lines(spark, sf).where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).unionByName(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")))
    f = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"), F.lit(True).alias("common"))
    return u.groupBy("id").agg(F.count("*").alias("n")).join(f, "id", "left").select("id", "n", F.coalesce("common", F.lit(False)).alias("common"))


def bootstrap_delta(spark, sf):
    """95 % interval of the paired difference; no SQL twin, tested by its coverage of the mean."""
    p = _pairs(spark, sf).select(F.lit("price").alias("metric"), "l_partkey", "delta")
    return ex.bootstrap_interval(p, "metric", "delta", draws=500)


QUERIES["bootstrap_delta"] = bootstrap_delta
