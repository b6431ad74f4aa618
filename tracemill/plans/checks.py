"""Queries of gates, guards, set accounting and assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import text as tx
from tracemill.functions.common import r6, ratio
from tracemill.operators import experiment as ex
from tracemill.operators import groups as gr
from tracemill.sources.logs import read_any
from tracemill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def raising(rows, wrong, message):
    """``rows``, or an error with the message at the first row that is wrong."""
    return rows.where(F.coalesce(F.when(~wrong, F.lit(True)), F.raise_error(message).cast("boolean")))


@query("select c_custkey from customer order by c_custkey offset 100 limit greatest((select count(*) from customer) - 150, 0)")
def sliced_read(spark, sf):
    """Rows 100 to 50 before the end, in the order of the file."""
    return read_any(spark, f"{sf}/customer.parquet@[100:-50]").select("c_custkey")


@query("""with a as (select run_id, task_id, count(*) as attempts, max((status = 'completed')::int) as done from traces group by 1, 2) select run_id, task_id, attempts::bigint as attempts from a where coalesce(done, 0) = 0 and attempts < 3""")
def pending_capped(spark, sf):
    """Jobs not completed and still under the attempt cap."""
    a = table(spark, sf, "traces").groupBy("run_id", "task_id").agg(F.count("*").alias("attempts"), F.coalesce(F.max((F.col("status") == "completed").cast("int")), F.lit(0)).alias("done"))
    return a.where("done = 0 and attempts < 3").select("run_id", "task_id", "attempts")


@query("""with g as (select run_id, task_id, bool_and(reward is not null) as whole from traces group by 1, 2) select delivery_id from traces join g using (run_id, task_id) where whole""")
def whole_groups(spark, sf):
    """Members of groups all of whose members are scored."""
    t = table(spark, sf, "traces")
    g = t.groupBy("run_id", "task_id").agg(F.bool_and(F.col("reward").isNotNull()).alias("whole")).where("whole")
    return t.join(g, ["run_id", "task_id"], "left_semi").select("delivery_id")


@query("""with r as (select delivery_id, reward from traces where reward is not null and isfinite(reward)) select delivery_id, reward, (reward >= 1)::int as success from r""")
def valid_rewards(spark, sf):
    """Finite rewards with their success flag; a flag that is neither 0 nor 1 raises."""
    r = table(spark, sf, "traces").where(F.col("reward").isNotNull() & ~F.isnan("reward") & (F.abs("reward") != float("inf"))).select("delivery_id", "reward", (F.col("reward") >= 1).cast("int").alias("success"))
    return raising(r, ~F.col("success").isin(0, 1), F.lit("success is neither 0 nor 1"))


@query("""with a as (select distinct task_id from traces), b as (select distinct task_id from tasks) select (select count(*) from (select * from a except select * from b))::bigint as unknown, (select count(*) from (select * from b except select * from a))::bigint as unused,
not exists (select * from a except select * from b) and not exists (select * from b except select * from a) as equal""")
def set_equality(spark, sf):
    """Two id sets compared both ways."""
    a, b = (table(spark, sf, t).select("task_id").distinct() for t in ("traces", "tasks"))
    left, right = a.exceptAll(b).agg(F.count("*").alias("unknown")), b.exceptAll(a).agg(F.count("*").alias("unused"))
    return left.crossJoin(right).withColumn("equal", (F.col("unknown") == 0) & (F.col("unused") == 0))  # one row each


@query("""with c as (select distinct batch_no, unnest(source_card_ids) as card from proposal_ledger), cited as (select distinct batch_no, card from c where card is not null),
kept as (select distinct batch_no, unnest(source_card_ids) as card from proposal_ledger where operation = 'REWRITE')
select cited.batch_no, count(*)::bigint as cards, count(kept.card)::bigint as by_rewrites, count(*) filter (kept.card is null)::bigint as by_adds_only from cited left join kept on kept.batch_no is not distinct from cited.batch_no and kept.card = cited.card group by 1""")
def evidence_accounting(spark, sf):
    """Cards cited in a batch, split into two disjoint sets whose union is all of them."""
    c = table(spark, sf, "proposal_ledger").select("batch_no", F.explode("source_card_ids").alias("card"), (F.col("operation") == "REWRITE").alias("rewrite")).where("card is not null")
    by = c.groupBy("batch_no", "card").agg(F.max("rewrite").alias("rewrite"))
    return by.groupBy("batch_no").agg(F.count("*").alias("cards"), F.count_if("rewrite").alias("by_rewrites"), F.count_if(~F.col("rewrite")).alias("by_adds_only"))


@query("select * from (values (1, 1, 1, 1), (2, 2, 0, 0), (3, 0, 1, 1)) v(id, matched, missing, extra)")
def fuzzy_sets(spark, sf):
    """Values matched, missing and extra where equality is a token-set ratio above 85 (fixed cases)."""
    rows = [(1, ["red mug large", "lid"], ["large red mug", "handle"]), (2, ["Blue Cup", "set of two"], ["cup blue", "two set of"]), (3, ["abc"], ["xyz"])]
    df = spark.createDataFrame(rows, "id int, want array<string>, got array<string>")
    pairs = df.select("id", F.explode("want").alias("w"), "got").select("id", "w", F.explode("got").alias("g")).withColumn("same", tx.token_set_ratio("w", "g") > 85)
    want = pairs.groupBy("id", "w").agg(F.max("same").alias("s")).groupBy("id").agg(F.count_if("s").cast("int").alias("matched"), F.count_if(~F.col("s")).cast("int").alias("missing"))
    got = pairs.groupBy("id", "g").agg(F.max("same").alias("s")).groupBy("id").agg(F.count_if(~F.col("s")).cast("int").alias("extra"))
    return want.join(got, "id")


@query("""select round((sum(a * y) * sum(b * b) - sum(b * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)), 6) as beta_a,
round((sum(b * y) * sum(a * a) - sum(a * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)), 6) as beta_b, 2::bigint as rank from (select l_discount as a, l_tax as b, l_quantity as y from lineitem)""")
def refit_rank(spark, sf):
    """Least squares without an intercept refitted from the Gram matrix, with the design's rank."""
    l = table(spark, sf, "lineitem")
    return ex.refit(l, ["l_discount", "l_tax"], "l_quantity").select(r6("beta_l_discount").alias("beta_a"), r6("beta_l_tax").alias("beta_b"), "rank")


@query("""with g as (select l_partkey, count(distinct l_linestatus) as treatments, count(distinct l_orderkey) as members from lineitem group by 1) select l_partkey, members::bigint as members, case when treatments > 1 then 'mixed' when members >= 3 then 'fires' else 'waits' end as state from g""")
def coordinated_groups(spark, sf):
    """A group fires once when three different members have come; members of different treatments are an error state."""
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_linestatus").alias("t"), F.countDistinct("l_orderkey").alias("members"))
    return g.select("l_partkey", "members", F.when(F.col("t") > 1, "mixed").when(F.col("members") >= 3, "fires").otherwise("waits").alias("state"))


@query("""with m as (select stage, operation, count(*)::bigint as lines, count(*) filter (estimated_effect > 0)::bigint as positive, round(avg(estimated_effect), 6) as mean_effect, round(max(estimated_effect), 6) as best from proposal_ledger group by 1, 2) select * from m""")
def gate_metrics(spark, sf):
    e = F.col("estimated_effect")
    return table(spark, sf, "proposal_ledger").groupBy("stage", "operation").agg(F.count("*").alias("lines"), F.count_if(e > 0).alias("positive"), r6(F.avg(e)).alias("mean_effect"), r6(F.max(e)).alias("best"))


@query("""with r as (select l_partkey, l_orderkey, sum(l_quantity) as x, count(*) as n from lineitem group by 1, 2) select l_partkey, round(sum(x) / sum(n), 6) as per_token, round(avg(x / n), 6) as per_rollout from r group by 1""")
def two_divisors(spark, sf):
    """A metric over tokens, and over rollouts of their own means."""
    r = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("x"), F.count("*").alias("n"))
    return r.groupBy("l_partkey").agg(r6(ratio(F.sum("x"), F.sum("n"))).alias("per_token"), r6(F.avg(F.col("x") / F.col("n"))).alias("per_rollout"))


@query("""with g as (select l_partkey, l_orderkey, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem group by 1, 2) select count(*)::bigint as rollouts, count(*) filter (lo <> hi)::bigint as disagreeing from g""")
def sibling_agreement(spark, sf):
    """Rollouts whose rows state different rewards; a strict run raises on any."""
    g = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return g.agg(F.count("*").alias("rollouts"), F.count_if(F.col("lo") != F.col("hi")).alias("disagreeing"))


@query("""with g as (select sha256(coalesce(text, '')) as h, count(*) as n, count(distinct source) as s from documents group by 1) select count(*)::bigint as groups, count(*) filter (n > 1)::bigint as several, max(n)::bigint as largest, count(*) filter (s > 1)::bigint as across_sources from g""")
def group_sizes(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("several"), F.max("n").alias("largest"), F.count_if(F.col("s") > 1).alias("across_sources"))


@query("""select run_id, snapshot_no, string_agg('- ' || skill_id || ': ' || coalesce(version, 'none'), chr(10) order by contribution_rank nulls last, skill_id, bank_row) as page, count(*)::bigint as chunks from selected_skillbank where enabled group by 1, 2""")
def ordered_pages(spark, sf):
    """A bank's enabled chunks as one page of lines in rank order; a page is bounded by its bank."""
    rows = table(spark, sf, "selected_skillbank").where("enabled").groupBy("run_id", "snapshot_no").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("contribution_rank", F.lit(2**31 - 1)), "skill_id", "bank_row", F.coalesce("version", F.lit("none")).alias("v")))).alias("c"), F.count("*").alias("chunks")
    )
    return rows.select("run_id", "snapshot_no", F.array_join(F.transform("c", lambda x: F.concat(F.lit("- "), x["skill_id"], F.lit(": "), x["v"])), "\n").alias("page"), "chunks")


@query("""with f as (select candidate_id, sha256(concat_ws('|', coalesce(operation, ''), coalesce(target_chunk_id, ''), coalesce(content, ''))) as fp, batch_no, ledger_row from proposal_ledger), e as (select fp, min(batch_no) as first from f group by 1)
select ledger_row from f join e using (fp) where batch_no = first qualify row_number() over (partition by fp order by ledger_row) = 1""")
def new_signatures(spark, sf):
    """Lines whose signature no earlier batch has, one for each signature."""
    fp = F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("operation", "target_chunk_id", "content"))), 256)
    f = table(spark, sf, "proposal_ledger").select(fp.alias("fp"), "batch_no", "ledger_row")
    return f.groupBy("fp").agg(F.min(F.struct("batch_no", "ledger_row")).alias("m")).select("m.ledger_row")


@query("""select run_id, round_no, (count(*) filter (entry_kind = 'candidate') - count(distinct candidate_id) filter (entry_kind = 'candidate'))::bigint as repeated, count(*) filter (entry_kind = 'candidate' and operation not in ('ADD', 'REWRITE'))::bigint as unknown_operation from candidate_pool group by 1, 2""")
def pool_identity(spark, sf):
    c = F.col("entry_kind") == "candidate"
    return table(spark, sf, "candidate_pool").groupBy("run_id", "round_no").agg((F.count_if(c) - F.countDistinct(F.when(c, F.col("candidate_id")))).alias("repeated"), F.count_if(c & ~F.col("operation").isin("ADD", "REWRITE")).alias("unknown_operation"))


@query("""with a as (select p_brand, p_type, count(distinct p_retailprice) > 1 as varies from part group by 1, 2), x as (select p_brand, count(*) filter (varies) > 1 as out from a group by 1) select p_partkey, case when x.out then 'excluded' else 'kept' end as side from part join x using (p_brand)""")
def kept_and_excluded(spark, sf):
    """All rows, each on its side of the rule."""
    p = table(spark, sf, "part")
    x = p.groupBy("p_brand", "p_type").agg((F.countDistinct("p_retailprice") > 1).alias("v")).groupBy("p_brand").agg((F.count_if("v") > 1).alias("out"))
    return p.join(x, "p_brand").select("p_partkey", F.when(F.col("out"), "excluded").otherwise("kept").alias("side"))


@query("""with r as (select l_partkey, l_orderkey, max((l_returnflag = 'R')::int) as good, max((l_linestatus = 'O')::int) as cut, min(l_quantity) as size from lineitem group by 1, 2)
select count(*)::bigint as rollouts, round(avg(good), 6) as accuracy, round(avg(cut), 6) as cut_share, round(avg(size) filter (good = 1), 6) as good_size, round(avg(size) filter (good = 0), 6) as bad_size from r""")
def eval_rollup(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("g"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("c"), F.min("l_quantity").alias("s"))
    return r.agg(F.count("*").alias("rollouts"), r6(F.avg("g")).alias("accuracy"), r6(F.avg("c")).alias("cut_share"), r6(F.avg(F.when(F.col("g") == 1, F.col("s")))).alias("good_size"), r6(F.avg(F.when(F.col("g") == 0, F.col("s")))).alias("bad_size"))


@query("""with r as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as r, count(*) over () as n, row_number() over (order by sha256('3:' || c_custkey), c_custkey) as h from customer)
select 'top' as arm, c_custkey from r where r <= 20 union all select 'bottom', c_custkey from r where r > n - 20 union all select 'random', c_custkey from r where h <= 20""")
def rank_arms(spark, sf):
    """Top, bottom and random arms of 20, by rank and by hash."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    arm = lambda df, name: df.limit(20).select(F.lit(name).alias("arm"), "c_custkey")
    return arm(c.orderBy(F.desc("c_acctbal"), "c_custkey"), "top").unionByName(arm(c.orderBy("c_acctbal", F.desc("c_custkey")), "bottom")).unionByName(arm(c.orderBy(F.sha2(F.concat_ws(":", F.lit("3"), F.col("c_custkey").cast("string")), 256), "c_custkey"), "random"))


@query("""with m as (select bank_row, run_id, skill_id, content, sum(case when estimated_effect > 0 then 1 else 0 end) over (partition by run_id, skill_id) as ups from selected_skillbank)
select run_id, skill_id, count(distinct content)::bigint as contents, bool_or(ups > 0) as positive from m group by 1, 2""")
def constant_contexts(spark, sf):
    """Whether a skill's content stays the same over its snapshots, and its sign."""
    return table(spark, sf, "selected_skillbank").groupBy("run_id", "skill_id").agg(F.countDistinct("content").alias("contents"), (F.count_if(F.col("estimated_effect") > 0) > 0).alias("positive"))


@query("""select o_orderkey, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)::int as choice, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1.0 else 0.0 end as exact from orders""")
def exact_match_list(spark, sf):
    """Equality with any of a list of answers."""
    answers = F.array(*(F.lit(x) for x in ("1 urgent", "2 HIGH")))
    norm = tx.normal_answer(F.regexp_replace("o_orderpriority", "-", " "))
    hit = F.exists(answers, lambda a: F.lower(a) == norm)
    order = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    place = F.nullif(F.array_position(order, F.col("o_orderpriority")), F.lit(0)).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", place.alias("choice"), F.when(hit, 1.0).otherwise(0.0).alias("exact"))


@query("""with w as (select l_partkey, l_orderkey, min(l_linenumber) as ln, max((l_returnflag = 'R')::int) as bad from lineitem group by 1, 2),
s as (select *, row_number() over (partition by l_partkey order by ln, l_orderkey) - row_number() over (partition by l_partkey, bad order by ln, l_orderkey) as g from w) select l_partkey, max(n)::bigint as longest from (select l_partkey, g, count(*) as n from s where bad = 1 group by 1, 2) group by 1""")
def longest_streaks(spark, sf):
    """The longest run of failing rollouts of a group, by gaps and islands."""
    w = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min("l_linenumber").alias("at"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("bad"))
    by = Window.partitionBy("l_partkey").orderBy("at", "l_orderkey")
    own = Window.partitionBy("l_partkey", "bad").orderBy("at", "l_orderkey")
    s = w.withColumn("g", F.row_number().over(by) - F.row_number().over(own)).where("bad = 1")
    return s.groupBy("l_partkey", "g").agg(F.count("*").alias("n")).groupBy("l_partkey").agg(F.max("n").alias("longest"))
