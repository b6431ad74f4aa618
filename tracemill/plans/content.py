"""Queries over documents, catalog rows, hierarchies, intervals and the experiment's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import text as tx
from tracemill.functions.common import r6, ratio
from tracemill.operators import catalog as cat
from tracemill.operators import components as cc
from tracemill.operators import episodes as ep
from tracemill.operators import experiment as ex
from tracemill.operators import leakage as lk
from tracemill.operators import retrieval as rt
from tracemill.operators.nested import strict_json
from tracemill.functions.common import global_rank
from tracemill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Retrieval ----------------------------------------------------------------------

ASKED = [(0, "travel"), (0, "towel"), (1, "photo"), (1, "frame"), (2, "javascript"), (2, "browser"), (3, "budget"), (4, "round"), (4, "beta")]


@query(f"""with q(query_id, term) as (values {', '.join(f"({i}, '{t}')" for i, t in ASKED)}),
t as (select doc_id, {_TOK.format('text')} as t from documents), z as (select doc_id, len(t) as size from t), st as (select count(*) as n, avg(size) as m from z),
p as (select doc_id, unnest(t) as term from t), f as (select doc_id, term, count(*) as f from p where term in (select term from q) group by 1, 2), d as (select term, count(*) as n from f group by 1),
s as (select q.query_id, f.doc_id as doc, round(sum(case when ln((st.n - d.n + 0.5) / (d.n + 0.5)) > 0 then ln((st.n - d.n + 0.5) / (d.n + 0.5)) else 1e-6 end * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * z.size / st.m))), 6) as score
from f join d using (term) join z using (doc_id) join q using (term) cross join st group by 1, 2)
select query_id, doc, score, row_number() over (partition by query_id order by score desc, doc) as hit_rank from s qualify hit_rank <= 150""")
def bm25_documents(spark, sf):
    q = spark.createDataFrame(ASKED, "query_id int, term string")
    return rt.bm25(table(spark, sf, "documents"), "doc_id", {"text": 1.0}, q, 150).withColumn("hit_rank", F.col("hit_rank").cast("bigint"))


@query()
def bm25_documents_han(spark, sf):
    """Every document whose number is divisible by 20 asks with all its tokens; indexed with Latin words and Han pairs."""
    d = table(spark, sf, "documents")
    q = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.explode(rt.search_tokens(F.col("text"))).alias("term"))
    return rt.bm25_blocks(d, "doc_id", "text", q, 150)


_PART_BM25 = f"""q as (select p_partkey as query_id, unnest(list_distinct({_TOK.format('p_name')})) as term from part where p_partkey % 20 = 0),
t as (select p_partkey, {_TOK.format('p_name')} as a, {_TOK.format('p_brand')} as b, {_TOK.format('p_type')} as c from part),
z as (select p_partkey, len(a) + len(b) + len(c) as size from t), st as (select count(*) as n, avg(size) as m from z),
p as (select p_partkey, unnest(a) as term, 3.0 as w from t union all select p_partkey, unnest(b), 2.0 from t union all select p_partkey, unnest(c), 1.0 from t),
f as (select p_partkey, term, sum(w)::double as f from p group by 1, 2), d as (select term, count(*) as n from f group by 1),
s as (select q.query_id, f.p_partkey as doc, round(sum(case when ln((st.n - d.n + 0.5) / (d.n + 0.5)) > 0 then ln((st.n - d.n + 0.5) / (d.n + 0.5)) else 1e-6 end * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * z.size / st.m))), 6) as score
from f join d using (term) join z using (p_partkey) join q using (term) cross join st group by 1, 2),
h as (select *, row_number() over (partition by query_id order by score desc, doc) as hit_rank from s qualify hit_rank <= 150)"""


def _part_hits(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    q = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.array_distinct(rt.latin_tokens(F.col("p_name")))).alias("term"))
    return rt.bm25(p, "p_partkey", {"p_name": 3.0, "p_brand": 2.0, "p_type": 1.0}, q, 150)


@query(f"with {_PART_BM25} select query_id, doc, score, hit_rank from h")
def bm25_parts_multifield(spark, sf):
    return _part_hits(spark, sf).withColumn("hit_rank", F.col("hit_rank").cast("bigint"))


@query(f"""with {_PART_BM25}, g as (select p.p_partkey, h.hit_rank from part p left join h on h.query_id = p.p_partkey and h.doc = p.p_partkey where p.p_partkey % 20 = 0)
select count(*)::bigint as queries, round(avg(coalesce((hit_rank <= 1)::int, 0)), 6) as recall_1, round(avg(coalesce((hit_rank <= 20)::int, 0)), 6) as recall_20, round(avg((hit_rank is not null)::int), 6) as recall_all, round(avg(coalesce(1.0 / hit_rank, 0)), 6) as mrr from g""")
def recall_mrr(spark, sf):
    gold = table(spark, sf, "part").where("p_partkey % 20 = 0").select("p_partkey")
    hits = _part_hits(spark, sf).where("query_id = doc").select(F.col("doc").alias("p_partkey"), "hit_rank")
    return rt.rank_metrics(gold.join(hits, "p_partkey", "left"), "hit_rank", [])


@query(f"with {_PART_BM25} select query_id, h.hit_rank, p_name, p_retailprice, ((h.hit_rank - 1) // 20 + 1)::bigint as page from h join part on p_partkey = doc where h.hit_rank <= 40")
def ranked_lookup(spark, sf):
    """Hits as catalog rows in rank order, with their page."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), "p_name", "p_retailprice")
    h = _part_hits(spark, sf).where("hit_rank <= 40").join(p, "doc")
    return h.select("query_id", F.col("hit_rank").cast("bigint").alias("hit_rank"), "p_name", "p_retailprice", F.expr("cast((hit_rank - 1) div 20 + 1 as bigint)").alias("page"))


@query(f"""select doc_id, len({_TOK.format('text')})::int as tokens, len(list_distinct({_TOK.format('text')}))::int as distinct_tokens from documents where text is not null""")
def search_token_counts(spark, sf):
    t = rt.latin_tokens(F.col("text"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


# Components and splits ----------------------------------------------------------

_LINK = """lk as (select doc_id, 't' || md5(lower(text)) as k from documents where text is not null union all select doc_id, 'c' || round_id || '|' || n_chars from documents where round_id is not null),
ed as (select a.doc_id as x, b.hub as y from lk a join (select k, min(doc_id) as hub from lk group by 1) b on a.k = b.k where a.doc_id <> b.hub),
bi as (select distinct x, y from (select x, y from ed union all select y, x from ed)),
re as (with recursive r(x, y) as (select x, y from bi union select r.x, bi.y from r join bi on r.y = bi.x) select x, min(y) as m from r group by 1),
co as (select doc_id, least(doc_id, coalesce(m, doc_id)) as component from documents left join re on x = doc_id)"""


def _components(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "round_id", "n_chars", F.md5(F.lower("text")).alias("h"))
    keys = F.array(F.concat(F.lit("t"), F.col("h")), F.concat(F.lit("c"), F.col("round_id"), F.lit("|"), F.col("n_chars").cast("string")))
    return cc.components(d.select("doc_id", F.explode(keys).alias("k")), "doc_id", "k")


@query(f"with {_LINK} select doc_id, component from co")
def linked_components(spark, sf):
    """Documents linked by equal text, or by round and length."""
    return _components(spark, sf)


@query("""with s as (select o_orderkey, case when o_orderkey % 10 = 0 then 'test' when o_orderkey % 10 = 1 then 'val' else 'train' end as split from orders)
select split, count(*)::bigint as n, count(*) filter (o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R'))::bigint as covered from s group by 1""")
def split_checks(spark, sf):
    """Sizes of disjoint splits and how many of each another set covers."""
    k = F.col("o_orderkey")
    s = table(spark, sf, "orders").select(k, F.when(k % 10 == 0, "test").when(k % 10 == 1, "val").otherwise("train").alias("split"))
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    return s.join(r, "o_orderkey", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("hit").alias("covered"))


@query("""with r(split, lo, hi) as (values ('a', 0, 4000), ('b', 3000, 9000), ('c', 9000, 1000000000)) select o_orderkey, split from orders join r on o_orderkey >= lo and o_orderkey < hi""")
def range_splits(spark, sf):
    """Explicit, overlapping ranges of three rows; the range table is a constant, so its broadcast is bounded."""
    r = spark.createDataFrame([("a", 0, 4000), ("b", 3000, 9000), ("c", 9000, 10**9)], "split string, lo long, hi long")
    return table(spark, sf, "orders").join(r, (F.col("o_orderkey") >= F.col("lo")) & (F.col("o_orderkey") < F.col("hi"))).select("o_orderkey", "split")


@query("select coalesce(split_name, 'none') as split_name, count(*)::bigint as tasks, count(distinct asin)::bigint as products, count(price_upper)::bigint as priced, round(avg(price_upper), 4) as mean_upper from tasks group by 1")
def split_stats(spark, sf):
    return table(spark, sf, "tasks").groupBy(F.coalesce("split_name", F.lit("none")).alias("split_name")).agg(F.count("*").alias("tasks"), F.countDistinct("asin").alias("products"), F.count("price_upper").alias("priced"), F.round(F.avg("price_upper"), 4).alias("mean_upper"))


# Text rules ---------------------------------------------------------------------


@query(r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'task-[0-9]+(__sample-[0-9]+)?', '<task>', 'g'), 'chunk-[0-9a-f]{12}', '<chunk>', 'g'), 'A[0-9A-F]{7,10}', '<product>', 'g')) as digest from documents where text is not null""")
def redaction(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(tx.redacted(F.col("text")), 256).alias("digest"))


@query("""select ledger_row, regexp_extract_all(content, '\\b(?:chunk|online|cluster)-[0-9a-f]{12,16}\\b') <> [] as has_id, contains(lower(content), 'asin') as names_asin, target_chunk_id is not null and contains(content, target_chunk_id) as names_target
from proposal_ledger where content is not null""")
def leakage_firewall(spark, sf):
    """Findings by rule: numbers of the experiment, field names, and the row's own target."""
    c = F.col("content")
    d = table(spark, sf, "proposal_ledger").where("content is not null")
    return d.select("ledger_row", c.rlike(r"\b(?:chunk|online|cluster)-[0-9a-f]{12,16}\b").alias("has_id"), F.contains(F.lower(c), F.lit("asin")).alias("names_asin"), F.coalesce(F.contains(c, F.col("target_chunk_id")), F.lit(False)).alias("names_target"))


@query()
def leakage_known(spark, sf):
    """Findings of each whole content: field names, long identifiers, task ids, and any title, brand or gold option that a trace knows."""
    d = table(spark, sf, "proposal_ledger").where("content is not null").select("ledger_row", "content")
    c = F.col("content")
    known = lk.known_terms(table(spark, sf, "traces"), "trace")
    hits = lk.copied(d, "ledger_row", "content", known).groupBy("ledger_row").agg(*(F.max(F.col("kind") == k).alias(f"copies_{k}") for k in lk.KINDS))
    rules = d.select("ledger_row", c.rlike(r"(?i)\bASIN\b").alias("mentions_asin"), c.rlike(r"(?U)\b\d{10,}\b").alias("long_identifier"), c.rlike(r"(?iU)\btask[-_ ]?\d+\b").alias("task_id"))
    out = rules.join(hits, "ledger_row", "left")
    return out.select(*rules.columns, *(F.coalesce(f"copies_{k}", F.lit(False)).alias(f"copies_{k}") for k in lk.KINDS))


_NA = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""with n as (select p_partkey, {_NA.format("p_name || ' ' || p_type")} as a, {_NA.format("'the ' || p_name || ', ' || p_brand")} as b from part),
w as (select *, list_filter(string_split(a, ' '), lambda x: x <> '') as x, list_filter(string_split(b, ' '), lambda x: x <> '') as y from n),
c as (select *, list_sum(list_transform(list_distinct(x), lambda u: least(len(list_filter(x, lambda v: v = u)), len(list_filter(y, lambda v: v = u))))) as bth from w)
select p_partkey, round(case when bth = 0 then 0.0 else 2.0 * bth / (len(x) + len(y)) end, 6) as f1, a = b as exact from c""")
def token_f1(spark, sf):
    p = table(spark, sf, "part")
    a, b = tx.normal_answer(F.concat_ws(" ", "p_name", "p_type")), tx.normal_answer(F.concat(F.lit("the "), "p_name", F.lit(", "), "p_brand"))
    return p.select("p_partkey", r6(tx.token_f1(a, b)).alias("f1"), (a == b).alias("exact"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then upper(chr(65 + (o_orderkey % 4)::int)) when 1 then 'B' when 2 then 'C' else null end as letter from orders""")
def answer_letters(spark, sf):
    """Chosen letters from three ways of writing, and none."""
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "The answer is (A)").when(k == 1, "So (B) it is, not (C)").when(k == 2, "I choose C").otherwise("none of them")
    return table(spark, sf, "orders").select("o_orderkey", tx.choice_letter(said).alias("letter"))


@query(r"""with s as (select event_id, case event_id % 4 when 0 then 'search[' || event_type || ']' when 1 then 'open[A' || event_id || '] then buy[now]' when 2 then ' buy[now] ' else 'nothing' end as a from events)
select event_id, case when regexp_full_match(trim(a), '[a-z_]+\[[^\[\]]*\]') then regexp_extract(trim(a), '^([a-z_]+)\[', 1) end as verb, case when regexp_full_match(trim(a), '[a-z_]+\[[^\[\]]*\]') then regexp_extract(trim(a), '\[([^\[\]]*)\]$', 1) end as arg from s""")
def action_grammar(spark, sf):
    k = F.col("event_id") % 4
    a = F.when(k == 0, F.concat(F.lit("search["), F.col("event_type"), F.lit("]"))).when(k == 1, F.concat(F.lit("open[A"), F.col("event_id").cast("string"), F.lit("] then buy[now]"))).when(k == 2, " buy[now] ").otherwise("nothing")
    verb, arg = tx.parse_action(a)
    return table(spark, sf, "events").select("event_id", verb.alias("verb"), arg.alias("arg"))


@query(r"""select doc_id, len(regexp_extract_all(text, '\{"tool":"([^"]+)"', 1))::int as calls, list_extract(regexp_extract_all(text, '\{"tool":"([^"]+)"', 1), 1) as first_tool from documents where text is not null""")
def tool_call_extract(spark, sf):
    calls = F.regexp_extract_all("text", F.lit(r'\{"tool":"([^"]+)"'), F.lit(1))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(calls).alias("calls"), F.try_element_at(calls, F.lit(1)).alias("first_tool"))


@query("""select doc_id, regexp_extract(text, '([0-9]+)元', 1) as amount, substr(text, greatest(instr(text, '元') - 10, 1), 21) as around from documents where contains(text, '元')""")
def snippet_context(spark, sf):
    """Text around the first mention of a price."""
    t = F.col("text")
    return table(spark, sf, "documents").where(F.contains(t, F.lit("元"))).select("doc_id", F.regexp_extract(t, "([0-9]+)元", 1).alias("amount"), t.substr(F.greatest(F.instr(t, "元") - 10, F.lit(1)), F.lit(21)).alias("around"))


@query("""select l.ledger_row, min(c.rn)::bigint as first_skill from (select ledger_row, content from proposal_ledger where content is not null) l
join (select skill_id, row_number() over (order by skill_id) as rn from curriculum) c on contains(l.content, substr(c.skill_id, 7, 2)) group by 1""")
def contains_first_match(spark, sf):
    """The first of the curriculum's marks that a text contains: each text meets all marks, the least place stays."""
    marks = table(spark, sf, "curriculum").select(F.substring("skill_id", 7, 2).alias("mark"), F.row_number().over(Window.orderBy("skill_id")).cast("bigint").alias("place"))
    rows = table(spark, sf, "proposal_ledger").where("content is not null").select("ledger_row", "content")
    return rows.join(marks, F.contains("content", "mark")).groupBy("ledger_row").agg(F.min("place").alias("first_skill"))


@query("select doc_id from documents where length(text) - length(replace(text, ' ', '')) + 1 <= 200")
def length_filter(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").where(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1 <= 200).select("doc_id")


@query("select doc_id from documents where text is not null qualify row_number() over (partition by sha256(text) order by doc_id) = 1")
def first_seen_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return cat.first_seen(d, F.col("h"), ["doc_id"]).select("doc_id")


@query("""select doc_id, row_number() over (order by doc_id) - 1 as dense_id, substr(sha256(coalesce(text, '')), 1, 24) as uid from documents""")
def dense_ids_uids(spark, sf):
    """Dense numbers given before any filter, and content ids."""
    d = table(spark, sf, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 24).alias("uid"))
    return global_rank(d, "doc_id").select("doc_id", (F.col("rank_no") - 1).alias("dense_id"), "uid")


@query("""with h as (select doc_id, sha256(text) as fp from documents where text is not null and doc_id % 3 = 0) select d.doc_id from documents d where text is not null and not exists (select 1 from h where h.doc_id = d.doc_id and h.fp = sha256(d.text))""")
def pending_by_fingerprint(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("fp"))
    return d.join(d.where("doc_id % 3 = 0"), ["doc_id", "fp"], "left_anti").select("doc_id")


@query("""select task_id, case when instruction like '%预算%' then try_cast(regexp_extract(instruction, '预算([0-9]+)元', 1) as double) when instruction like '%at most%' then try_cast(regexp_extract(instruction, 'at most ([0-9]+)', 1) as double)
when instruction like '%元左右%' then round(1.1 * try_cast(regexp_extract(instruction, '([0-9]+)元左右', 1) as double), 6) end as ceiling from tasks""")
def budget_ceilings(spark, sf):
    return table(spark, sf, "tasks").select("task_id", tx.budget_ceiling(F.col("instruction")).alias("ceiling"))


# Catalog ------------------------------------------------------------------------


@query("""with a as (select p_brand, p_type, count(distinct p_retailprice) > 1 as varies from part group by 1, 2) select p_brand, count(*) filter (varies)::bigint as varying_axes, case when count(*) filter (varies) > 1 then 'several_price_axes' end as reason from a group by 1""")
def catalog_partition(spark, sf):
    return cat.price_axes(table(spark, sf, "part"), "p_brand", "p_type", "p_retailprice")


@query("""select c_custkey, row_number() over (partition by e order by sha256('5:' || e || ':' || c_custkey), c_custkey) - 1 as place, e as epoch from customer cross join (select unnest([0, 1]) as e)""")
def epoch_batches(spark, sf):
    """Two epochs' orders by hash; places by hash range, not one sorted task."""
    parts = []
    for e in (0, 1):
        d = cat.epoch_order(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "5", e)
        d = d.withColumn("_n", F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint"))
        rows = d.withColumn("_b", F.expr("_n div 16777216"))
        starts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
        starts = starts.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
        place = F.col("_s") + F.row_number().over(Window.partitionBy("_b").orderBy("shuffle_key", "c_custkey")) - 1
        parts.append(rows.join(starts, "_b").select("c_custkey", place.alias("place"), F.lit(e).alias("epoch")))
    return parts[0].unionByName(parts[1])


@query("select p_partkey, p_name from part order by p_retailprice desc, p_partkey limit 20 offset 40")
def ranked_page(spark, sf):
    """Page three of a ranking."""
    return table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20).select("p_partkey", "p_name")


@query("""select p_partkey, lower(trim(p_name)) as title, coalesce(nullif(p_brand, ''), 'unknown') as shop, round(coalesce(p_retailprice, 100.0), 2) as price, '$' || printf('%.2f', p_retailprice) as price_tag from part""")
def normalized_row(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("title"), F.coalesce(F.nullif("p_brand", F.lit("")), F.lit("unknown")).alias("shop"), F.round(F.coalesce("p_retailprice", F.lit(100.0)), 2).alias("price"), F.format_string("$%.2f", "p_retailprice").alias("price_tag"))


@query("select p_partkey as id, p_name as name, 'part' as channel from part union all select s_suppkey, s_name, 'supplier' from supplier")
def union_projection(spark, sf):
    one = lambda t, k, n, c: table(spark, sf, t).select(F.col(k).alias("id"), F.col(n).alias("name"), F.lit(c).alias("channel"))
    return one("part", "p_partkey", "p_name", "part").unionByName(one("supplier", "s_suppkey", "s_name", "supplier"))


@query("""select p_partkey, p_brand from part where p_size <= 25 qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 3""")
def scoped_selection(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").where("p_size <= 25").withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_partkey", "p_brand")


@query("""select ledger_row, coalesce(len(source_card_ids), 0)::int as cited, case when operation = 'REWRITE' and target_chunk_id is null then 'no_target' when operation = 'ADD' and target_chunk_id is not null then 'target_on_add' when source_card_ids is null then 'no_evidence' else 'ok' end as finding from proposal_ledger""")
def evidence_rules(spark, sf):
    """Rules of operation, target and evidence; each row gets its first finding."""
    f = F.when((F.col("operation") == "REWRITE") & F.col("target_chunk_id").isNull(), "no_target").when((F.col("operation") == "ADD") & F.col("target_chunk_id").isNotNull(), "target_on_add").when(F.col("source_card_ids").isNull(), "no_evidence").otherwise("ok")
    return table(spark, sf, "proposal_ledger").select("ledger_row", F.when(F.col("source_card_ids").isNull(), 0).otherwise(F.size("source_card_ids")).alias("cited"), f.alias("finding"))


@query("""select p_partkey, case when shared >= 2 or t > 0.2 then 1.0 when t = 0 then 0.0 when t < 0.1 then 0.1 else 0.5 end as score from
(select p_partkey, len(list_intersect(string_split(lower(p_type || ' > ' || p_brand || ' > ' || p_name), ' > '), string_split('standard > brand#1 > red widget', ' > '))) as shared, (p_size % 10) / 30.0 as t from part)""")
def category_overlap_ladder(spark, sf):
    parts = cat.category_parts(F.concat_ws(" > ", "p_type", "p_brand", "p_name"))
    shared = F.size(F.array_intersect(parts, F.array(F.lit("standard"), F.lit("brand#1"), F.lit("red widget"))))
    return table(spark, sf, "part").select("p_partkey", cat.type_score(shared, (F.col("p_size") % 10) / 30.0).alias("score"))


@query("""select p_partkey, round(case when p_size % 5 = 0 then p_retailprice * 1.5 when p_size % 5 = 1 then p_retailprice when p_size % 5 = 2 then p_size::double else 100.0 end, 4) as price,
case when p_size % 3 = 0 then 1.0 when p_size % 5 > 2 then 0.0 else (case when p_size % 5 = 0 then p_retailprice * 1.5 when p_size % 5 = 1 then p_retailprice else p_size::double end <= 1000)::int::double end as price_ok from part""")
def price_resolution(spark, sf):
    s, p = F.col("p_size") % 5, F.col("p_retailprice")
    option, listed, base = F.when(s == 0, p * 1.5), F.when(s == 1, F.array(p)), F.when(s == 2, F.col("p_size").cast("double"))
    known = F.when(s <= 2, cat.resolved_price(listed, option, base))
    return table(spark, sf, "part").select("p_partkey", F.round(cat.resolved_price(listed, option, base), 4).alias("price"), cat.price_score(known, F.when(F.col("p_size") % 3 != 0, 1000.0)).alias("price_ok"))


@query("""select p_partkey, round(1.0 * (len(list_intersect(['red', p_brand], string_split(p_name, ' '))) + (p_size <= 25)::int + 1) / 4, 6) as loose from part""")
def loose_rewards(spark, sf):
    """Loose reward of each part against two wanted attributes, one option and a fitting price."""
    size = F.when(F.col("p_size") <= 25, "small").otherwise("large")
    r = cat.loose_reward(F.lit(1.0), F.split("p_name", " "), F.array(F.lit("red"), F.col("p_brand")), F.array(size), F.array(F.lit("small")), F.lit(1.0))
    return table(spark, sf, "part").select("p_partkey", r6(r).alias("loose"))


@query("""with b as (select o_orderkey, case when o_orderkey % 7 <> 0 then o_orderkey * 2 end as n from orders), u as (select distinct n from b where n is not null), m as (select count(*) as m from b where n is null),
f as (select i, row_number() over (order by i) as r from range(0, (select 2 * max(o_orderkey) + 2 from orders)) t(i) where i not in (select n from u)), w as (select o_orderkey, row_number() over (order by o_orderkey) as r from b where n is null)
select b.o_orderkey, coalesce(b.n, f.i)::bigint as rollout_id from b left join w on w.o_orderkey = b.o_orderkey left join f on f.r = w.r""")
def fill_unused_ids(spark, sf):
    k = F.col("o_orderkey")
    b = table(spark, sf, "orders").select(k, F.when(k % 7 != 0, k * 2).alias("rollout_id"))
    return cat.unused_numbers(b, "rollout_id", "o_orderkey").select("o_orderkey", F.col("rollout_id").cast("bigint").alias("rollout_id"))


@query("select p_partkey, case when r between 21 and 40 then r - 20 when r <= 20 then r + 20 else r end as place from (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) as r from part qualify r <= 60)")
def result_rotation(spark, sf):
    """Places 21 to 40 go to the front."""
    top = table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(60)
    r = F.col("r")
    return top.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).cast("bigint").alias("r")).select("p_partkey", F.when(r.between(21, 40), r - 20).when(r <= 20, r + 20).otherwise(r).alias("place"))


@query("""with v as (select p_partkey, string_split(p_name, ' ') as a, [p_brand, 'widget', 'red'] as b from part) select p_partkey, len(list_filter(b, lambda x: list_contains(a, x)))::int as matched, len(list_filter(b, lambda x: not list_contains(a, x)))::int as missing, len(list_filter(a, lambda x: not list_contains(b, x)))::int as extra from v""")
def value_set_diff(spark, sf):
    a, b = F.split("p_name", " "), F.array(F.col("p_brand"), F.lit("widget"), F.lit("red"))
    n = lambda x, y, inside: F.size(F.filter(x, lambda v: F.array_contains(y, v) if inside else ~F.array_contains(y, v)))
    return table(spark, sf, "part").select("p_partkey", n(b, a, True).alias("matched"), n(b, a, False).alias("missing"), n(a, b, False).alias("extra"))


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 500 offset 100")
def row_slice(spark, sf):
    """Rows 100 to 600 of the table's order."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(500)


# Intervals and hierarchy ---------------------------------------------------------

_INT = """iv as (select l_suppkey, l_shipdate as s, l_shipdate + to_days(l_quantity::int) as e from lineitem),
nw as (select *, case when s <= max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from iv),
il as (select *, sum(n) over (partition by l_suppkey order by s, e rows unbounded preceding) as g from nw), mg as (select l_suppkey, g, min(s) as s, max(e) as e, count(*)::bigint as parts from il group by 1, 2)"""


def _merged(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("s"), F.expr("l_shipdate + make_dt_interval(cast(l_quantity as int))").alias("e"))
    return ep.interval_union(l, ["l_suppkey"], "s", "e")


@query(f"with {_INT} select l_suppkey, s, e, parts from mg")
def interval_union(spark, sf):
    return _merged(spark, sf)


@query(f"with {_INT}, g as (select l_suppkey, e as gap_start, lead(s) over (partition by l_suppkey order by s) as gap_end from mg) select * from g where gap_end > gap_start order by gap_end - gap_start desc, l_suppkey, gap_start limit 15")
def top_gaps(spark, sf):
    """The 15 longest gaps: a top-k report."""
    g = ep.gaps(_merged(spark, sf), ["l_suppkey"], "s", "e")
    return g.orderBy((F.col("gap_end") - F.col("gap_start")).desc(), "l_suppkey", "gap_start").limit(15)


@query(f"with {_INT} select l_suppkey, count(*)::bigint as spans, round(sum(epoch(e) - epoch(s)) / nullif(max(epoch(e)) - min(epoch(s)), 0), 6) as utilization from mg group by 1")
def stream_utilization(spark, sf):
    """Busy time of each stream over the time between its first start and last end."""
    sec = lambda c: F.unix_timestamp(c)
    m = _merged(spark, sf)
    return m.groupBy("l_suppkey").agg(F.count("*").alias("spans"), r6(ratio(F.sum(sec("e") - sec("s")), F.max(sec("e")) - F.min(sec("s")))).alias("utilization"))


@query(f"""with {_INT}, g as (select l_suppkey, e as gap_start, lead(s) over (partition by l_suppkey order by s) as gap_end from mg qualify gap_end > gap_start)
select l_suppkey, gap_start, arg_min(c_custkey, (o_orderdate, o_orderkey)) as cause from g join (select o_orderkey, o_orderdate, o_custkey as c_custkey, o_orderkey % (select count(*) from supplier) as sk from orders) o on o.sk = g.l_suppkey and o_orderdate >= gap_start and o_orderdate < gap_end group by 1, 2""")
def gap_cause(spark, sf):
    """The first order of a supplier's own that falls into each gap: a range join within the key."""
    g = ep.gaps(_merged(spark, sf), ["l_suppkey"], "s", "e")
    n = table(spark, sf, "supplier").count()
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % n).alias("l_suppkey"), "o_orderdate", "o_orderkey", "o_custkey")
    j = g.join(o, "l_suppkey").where("o_orderdate >= gap_start and o_orderdate < gap_end")
    return j.groupBy("l_suppkey", "gap_start").agg(F.min_by("o_custkey", F.struct("o_orderdate", "o_orderkey")).alias("cause"))


@query("""select case when contains(p_name, 'widget') then 'widget' when contains(p_name, 'ring') then 'ring' when p_type = 'ECONOMY' then 'economy' else 'other' end as class, count(*)::bigint as n, round(sum(p_retailprice), 2) as total from part group by 1""")
def ordered_classifier(spark, sf):
    n = F.col("p_name")
    c = F.when(F.contains(n, F.lit("widget")), "widget").when(F.contains(n, F.lit("ring")), "ring").when(F.col("p_type") == "ECONOMY", "economy").otherwise("other")
    return table(spark, sf, "part").groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("select p_name, count(*)::bigint as n, round(sum(l_extendedprice), 2) as total from lineitem join part on p_partkey = l_partkey group by 1 order by total desc, p_name limit 30")
def top30(spark, sf):
    """The 30 largest names: a top-k report."""
    l, p = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice"), table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    per = l.groupBy("l_partkey").agg(F.count("*").alias("c"), F.sum("l_extendedprice").alias("t"))  # before the join: one row a part
    return per.join(p, "l_partkey").groupBy("p_name").agg(F.sum("c").alias("n"), F.round(F.sum("t"), 2).alias("total")).orderBy(F.desc("total"), "p_name").limit(30)


@query("""with recursive e as (select 'r' || r_regionkey as id, null as parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
t(id, root, depth) as (select id, id, 0 from e where parent is null union all select e.id, t.root, t.depth + 1 from e join t on e.parent = t.id) select root, depth, count(*)::bigint as n from t group by 1, 2""")
def ancestor_depth(spark, sf):
    """Depth and root of every node: one join a level, over three known levels."""
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(0).alias("depth"))
    edges = {1: table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("id")), 2: table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("id"))}
    out, level = r, r
    for d, e in edges.items():
        level = e.join(level, "id").select("root", F.col("child").alias("id"), F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out.groupBy("root", "depth").agg(F.count("*").alias("n"))


@query("""select n_name, o_orderstatus, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*)::bigint as lines from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' and l_returnflag <> 'R' group by 1, 2""")
def star_revenue(spark, sf):
    """Extension: a star join."""
    t = lambda n: table(spark, sf, n)
    n = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    o = t("orders").join(t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "n_name")
    l = t("lineitem").where("l_returnflag <> 'R'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name", "o_orderstatus").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("lines"))


# The experiment's own tables ------------------------------------------------------

_TR = "tr as (select delivery_id, run_id, lower(trim(episode_id)) as e, status, reward, duration_ms, delivered_at, case when json_valid(trace) then trace::json end as j from traces)"


@query(f"""with {_TR}, la as (select * from tr where e is not null qualify row_number() over (partition by run_id, e order by delivered_at desc nulls last, delivery_id desc) = 1)
select run_id, count(*)::bigint as episodes, count(*) filter (status = 'completed')::bigint as completed, count(*) filter (status = 'completed' and reward is not null)::bigint as scored,
round(avg(case when status = 'completed' then reward end), 6) as mean_reward, round(stddev_samp(case when status = 'completed' then reward end) / sqrt(count(case when status = 'completed' then reward end)), 6) as sem_reward, round(avg(duration_ms), 4) as mean_ms from la group by 1""")
def run_summary(spark, sf):
    """Per run over the holding delivery of each episode; technical failures keep no reward and stay out of the mean."""
    t = table(spark, sf, "traces").select("delivery_id", "run_id", F.lower(F.trim("episode_id")).alias("e"), "status", "reward", "duration_ms", "delivered_at").where("e is not null")
    rest = ["status", "reward", "duration_ms"]
    la = t.groupBy("run_id", "e").agg(F.max_by(F.struct(*rest), F.struct(F.col("delivered_at").isNotNull(), "delivered_at", "delivery_id")).alias("x")).select("run_id", "x.*")
    done = F.col("status") == "completed"
    r = F.when(done, F.col("reward"))
    return la.groupBy("run_id").agg(F.count("*").alias("episodes"), F.count_if(done).alias("completed"), F.count(r).alias("scored"), r6(F.avg(r)).alias("mean_reward"), r6(F.stddev_samp(r) / F.sqrt(F.count(r))).alias("sem_reward"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"))


@query(f"""with {_TR} select coalesce(status, 'none') as status, coalesce(j->>'$.schema_version', 'none') as schema_version, count(*)::bigint as n from tr group by 1, 2""")
def status_histogram(spark, sf):
    t = table(spark, sf, "traces").select(F.coalesce("status", F.lit("none")).alias("status"), F.coalesce(F.try_variant_get(strict_json(F.col("trace")), "$.schema_version", "string"), F.lit("none")).alias("schema_version"))
    return t.groupBy("status", "schema_version").agg(F.count("*").alias("n"))


@query("""select candidate_id, count(*)::bigint as lines, min(ledger_row) as first_row, arg_max(stage, (batch_no, ledger_row)) as last_stage from proposal_ledger where candidate_id is not null group by 1""")
def proposal_history(spark, sf):
    """The last line of each candidate, in first-seen order."""
    return table(spark, sf, "proposal_ledger").where("candidate_id is not null").groupBy("candidate_id").agg(F.count("*").alias("lines"), F.min("ledger_row").alias("first_row"), F.max_by("stage", F.struct("batch_no", "ledger_row")).alias("last_stage"))


@query("""with c as (select run_id, round_no, candidate_id, target_chunk_id, operation from candidate_pool where entry_kind = 'candidate'), s as (select distinct run_id, skill_id from candidate_pool where entry_kind = 'current')
select operation, case when operation = 'REWRITE' and target_chunk_id is null then 'no_target' when operation = 'REWRITE' and s.skill_id is null then 'unknown_target' else 'ok' end as finding, count(*)::bigint as n from c left join s on s.run_id = c.run_id and s.skill_id = c.target_chunk_id group by 1, 2""")
def pool_validation(spark, sf):
    p = table(spark, sf, "candidate_pool")
    c = p.where("entry_kind = 'candidate'").select("run_id", "operation", "target_chunk_id")
    s = p.where("entry_kind = 'current'").select("run_id", F.col("skill_id").alias("target_chunk_id"), F.lit(1).alias("known")).distinct()
    f = F.when((F.col("operation") == "REWRITE") & F.col("target_chunk_id").isNull(), "no_target").when((F.col("operation") == "REWRITE") & F.col("known").isNull(), "unknown_target").otherwise("ok")
    return c.join(s, ["run_id", "target_chunk_id"], "left").groupBy("operation", f.alias("finding")).agg(F.count("*").alias("n"))


@query("""select 'tasks_unique' as rule, (count(*) = count(distinct task_id)) as ok from tasks union all select 'traces_known_tasks', count(*) = 0 from traces where task_id not in (select task_id from tasks)
union all select 'families_in_curriculum', count(*) = 0 from proposal_ledger where replacement_family_id is not null and replacement_family_id not in (select skill_id from curriculum) union all select 'probabilities_in_range', bool_and(inclusion_probability between 0 and 1) from curriculum""")
def readiness_asserts(spark, sf):
    t = lambda n: table(spark, sf, n)
    rule = lambda df, name, c: df.agg(c.alias("ok")).select(F.lit(name).alias("rule"), "ok")
    known = t("traces").select("task_id").where("task_id is not null").distinct().join(t("tasks").select("task_id"), "task_id", "left_anti")
    fam = t("proposal_ledger").where("replacement_family_id is not null").select(F.col("replacement_family_id").alias("skill_id")).distinct().join(t("curriculum").select("skill_id"), "skill_id", "left_anti")
    out = [rule(t("tasks"), "tasks_unique", F.count("*") == F.countDistinct("task_id")), rule(known, "traces_known_tasks", F.count("*") == 0), rule(fam, "families_in_curriculum", F.count("*") == 0), rule(t("curriculum"), "probabilities_in_range", F.bool_and(F.col("inclusion_probability").between(0, 1)))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""select task_id, count(*)::bigint as cases, count(distinct run_id)::bigint as runs from cases group by 1""")
def case_counts(spark, sf):
    return table(spark, sf, "cases").groupBy("task_id").agg(F.count("*").alias("cases"), F.countDistinct("run_id").alias("runs"))


@query("""select split_name, instruction, task_id from tasks where split_name is not null and price_upper is not null""")
def exploded_subset(spark, sf):
    return table(spark, sf, "tasks").where("split_name is not null and price_upper is not null").select("split_name", "instruction", "task_id")
