"""Queries of corpus assembly, splits, search documents, comparisons, dumps and text rules on fixed cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import text as tx
from tracemill.functions.common import r6
from tracemill.operators import catalog as cat
from tracemill.operators import components as cc
from tracemill.operators import episodes as ep
from tracemill.operators import retrieval as rt
from tracemill.operators.nested import strict_json
from tracemill.session import work_path
from tracemill.sources import dumps
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


# Rows and projections ---------------------------------------------------------------


@query("select event_id, ts, user_id, event_type from events")
def dropped_columns(spark, sf):
    return table(spark, sf, "events").drop("value", "props", "no_such_column")


@query("""with t as (select delivery_id, case when json_valid(trace) then trace::json end as j from traces)
select delivery_id, try_cast(j->>'$.job.task_id' as bigint) as task_id, try_cast(j->>'$.job.seed' as bigint) as seed, j->>'$.job.split' as split, j->>'$.provenance.model.name' as model from t where j is not null""")
def comparable_plan(spark, sf):
    """The plan's fields that two runs must share."""
    v = strict_json(F.col("trace"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return table(spark, sf, "traces").select("delivery_id", v.alias("v")).where("v is not null").select("delivery_id", get("$.job.task_id", "bigint").alias("task_id"), get("$.job.seed", "bigint").alias("seed"), get("$.job.split", "string").alias("split"), get("$.provenance.model.name", "string").alias("model"))


@query("""with s as (select case when source_card_ids is null then 'no_list' when len(source_card_ids) = 0 then 'empty' else 'kept' end as reason, len(source_card_ids) as n from proposal_ledger)
select reason, count(*)::bigint as lines, coalesce(sum(n), 0)::bigint as goals from s group by 1""")
def goal_counters(spark, sf):
    """Lines that give goals, and those skipped, by reason."""
    n = F.size("source_card_ids")
    why = F.when(F.col("source_card_ids").isNull(), "no_list").when(n == 0, "empty").otherwise("kept")
    return table(spark, sf, "proposal_ledger").groupBy(why.alias("reason")).agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0)).cast("bigint").alias("goals"))


@query("""select ledger_row, i - 1 as place, source_card_ids[i] as card_id, ledger_row || '-' || (i - 1) as goal_id from (select ledger_row, source_card_ids, unnest(range(1, len(source_card_ids) + 1)) as i from proposal_ledger where source_card_ids is not null) where source_card_ids[i] is not null""")
def exploded_goals(spark, sf):
    """A row for each cited card with its place; null cards are skipped but count as places."""
    rows = table(spark, sf, "proposal_ledger").select("ledger_row", F.posexplode("source_card_ids").alias("place", "card_id")).where("card_id is not null")
    return rows.withColumn("place", F.col("place").cast("bigint")).withColumn("goal_id", F.concat_ws("-", "ledger_row", "place"))


@query("""select o_orderkey, o_orderdate, string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey, l_suppkey) as lines, count(*)::bigint as n from orders join lineitem on l_orderkey = o_orderkey where l_returnflag <> 'R' group by 1, 2""")
def rebuilt_records(spark, sf):
    """Eligible children put back into their parents in the order of their places; a parent's children are bounded by the record."""
    kids = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("k"), F.count("*").alias("n"))
    out = table(spark, sf, "orders").join(kids, F.col("l_orderkey") == F.col("o_orderkey"))
    return out.select("o_orderkey", "o_orderdate", F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("lines"), "n")


@query("""select task_id, substr(sha256('asin=' || lower(trim(coalesce(asin, ''))) || '|instruction=' || lower(trim(coalesce(instruction, '')))), 1, 16) as persona, count(*) over (partition by lower(trim(coalesce(asin, ''))), lower(trim(coalesce(instruction, '')))) > 1 as repeated from tasks""")
def persona_records(spark, sf):
    """Fingerprint of normalised keys, and whether it occurs more than once (by a count, not by a list)."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    keys = F.map_from_arrays(F.array(F.lit("instruction"), F.lit("asin")), F.array(norm("instruction"), norm("asin")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(keys)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    rows = table(spark, sf, "tasks").select("task_id", F.substring(F.sha2(text, 256), 1, 16).alias("persona"))
    return rows.join(rows.groupBy("persona").agg((F.count("*") > 1).alias("repeated")), "persona")


@query("""with t as (select delivery_id, case when json_valid(trace) then trace::json end as j from traces), s as (select delivery_id, json_extract(j, '$.steps[0].environment.observation_state.hits') as h from t where j is not null)
select delivery_id, least(json_array_length(h), 3)::int as shown, coalesce(json_array_length(h), 0)::int as total, h->>'$[0].asin' as first_asin from s where json_type(h) = 'ARRAY'""")
def observation_caps(spark, sf):
    """The first observation's hits, at most three shown; the count of all stays."""
    h = F.try_variant_get(F.try_variant_get(strict_json(F.col("trace")), "$.steps[0].environment.observation_state.hits", "variant"), "$", "array<variant>")
    rows = table(spark, sf, "traces").select("delivery_id", h.alias("h")).where("h is not null").withColumn("top", F.slice("h", 1, 3))
    return rows.select("delivery_id", F.size("top").alias("shown"), F.size("h").alias("total"), F.try_variant_get(F.try_element_at("top", F.lit(1)), "$.asin", "string").alias("first_asin"))


@query("""select p_partkey, case when p_size % 3 = 0 then p_brand when p_size % 3 = 1 then p_type end as chosen from part""")
def option_lookup(spark, sf):
    """A map looked up without regard to case: axes in any spelling, the asked one in another."""
    m = F.create_map(F.lit("Brand"), F.col("p_brand"), F.lit("TYPE"), F.col("p_type"))
    low = F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    asked = F.when(F.col("p_size") % 3 == 0, "bRAND").when(F.col("p_size") % 3 == 1, "Type").otherwise("size")
    return table(spark, sf, "part").select("p_partkey", F.try_element_at(low, F.lower(asked)).alias("chosen"))


@query("""with v as (select p_partkey, string_split(p_name, ' ') as got, [p_brand, 'widget', 'red', 'ring'] as want from part)
select p_partkey, len(list_filter(want, lambda x: list_contains(got, x)))::int as matched, len(list_filter(want, lambda x: not list_contains(got, x)))::int as missing, len(list_filter(got, lambda x: not list_contains(want, x)))::int as extra,
case when len(list_filter(want, lambda x: list_contains(got, x))) = 0 then 'none' when len(list_filter(got, lambda x: not list_contains(want, x))) = 0 then 'within' else 'partly' end as outcome from v""")
def outcome_report(spark, sf):
    got, want = F.split("p_name", " "), F.array("p_brand", F.lit("widget"), F.lit("red"), F.lit("ring"))
    rows = table(spark, sf, "part").select("p_partkey", got.alias("g"), want.alias("w"))
    within = lambda a, b: F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    hit = within(F.col("w"), F.col("g"))
    miss, more = F.size("w") - hit, F.size("g") - within(F.col("g"), F.col("w"))
    return rows.select("p_partkey", hit.alias("matched"), miss.alias("missing"), more.alias("extra"), F.when(hit == 0, "none").when(more == 0, "within").otherwise("partly").alias("outcome"))


@query("""select skill_id, string_agg(k || '=' || v, ';' order by k) as settings from (
select skill_id, 'mode' as k, case when contribution > 0 then 'live' else 'base' end as v from curriculum union all select skill_id, 'share', case when inclusion_probability > 0.5 then 'high' else 'low' end from curriculum union all select skill_id, 'tag', 'default' from curriculum where contribution <= 0) group by 1""")
def metadata_overrides(spark, sf):
    """Defaults under a row's own entries; a later map wins."""
    base = F.create_map(F.lit("mode"), F.lit("base"), F.lit("share"), F.lit("low"), F.lit("tag"), F.lit("default"))
    base = F.when(F.col("contribution") > 0, F.map_filter(base, lambda k, v: k != "tag")).otherwise(base)
    own = F.map_filter(F.create_map(F.lit("mode"), F.when(F.col("contribution") > 0, "live"), F.lit("share"), F.when(F.col("inclusion_probability") > 0.5, "high")), lambda k, v: v.isNotNull())
    merged = F.map_zip_with(base, own, lambda k, a, b: F.coalesce(b, a))
    return table(spark, sf, "curriculum").select("skill_id", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("settings"))


# Joins and checks -----------------------------------------------------------------------


@query("select delivery_id, t.task_id, coalesce(split_name, 'none') as split_name, task_uid from traces t join tasks k on k.task_id = t.task_id")
def assignment_lookup(spark, sf):
    """Every job must find its assignment; a job without one raises."""
    k = table(spark, sf, "tasks").select("task_id", "task_uid", F.coalesce("split_name", F.lit("none")).alias("split_name"), F.lit(True).alias("known"))
    rows = table(spark, sf, "traces").select("delivery_id", "task_id").join(k, "task_id", "left")
    return rows.where(F.coalesce("known", F.raise_error(F.concat(F.lit("no assignment for task "), F.col("task_id").cast("string"))).cast("boolean"))).drop("known")


@query("""select distinct p.candidate_id from candidate_pool p where entry_kind = 'candidate' and content is not null and length(content) > 20 and p.candidate_id is not null and not exists (select 1 from proposal_ledger l where l.candidate_id = p.candidate_id)""")
def legacy_import(spark, sf):
    """Rows of an old store that the new one lacks and that are still valid."""
    old = table(spark, sf, "candidate_pool").where("entry_kind = 'candidate' and length(content) > 20 and candidate_id is not null").select("candidate_id").distinct()
    return old.join(table(spark, sf, "proposal_ledger").select("candidate_id"), "candidate_id", "left_anti")


@query("""with r as (select run_id, count(*)::bigint as records, count(distinct case when episode_id is not null then lower(trim(episode_id)) end)::bigint as episodes from traces group by 1)
select p.run_id, r.records is not distinct from p.records as records_match, r.episodes is not distinct from p.unique_episodes as episodes_match, r.run_id is not null as has_traces from replay p left join r on r.run_id = p.run_id""")
def publication_checks(spark, sf):
    """Published figures against the same figures recomputed."""
    e = F.lower(F.regexp_replace("episode_id", r"^\s+|\s+$", ""))
    r = table(spark, sf, "traces").groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct(e).alias("e"), F.lit(True).alias("has"))
    p = table(spark, sf, "replay").join(r, "run_id", "left")
    return p.select("run_id", F.col("n").eqNullSafe(F.col("records")).alias("records_match"), F.col("e").eqNullSafe(F.col("unique_episodes")).alias("episodes_match"), F.coalesce("has", F.lit(False)).alias("has_traces"))


@query("""with t as (select task_id, asin from tasks), a as (select t.*, count(*) over (partition by asin) as size from t),
n as (select count(*) as n from tasks) select 'tasks' as rule, (select count(*) from tasks)::bigint as value union all select 'test_size', (n // 5)::bigint from n union all select 'val_size', (n // 5)::bigint from n
union all select 'split_groups', 0::bigint union all select 'unassigned', 0::bigint""")
def split_builder(spark, sf):
    """Test, then validation, then the rest, of whole linked groups of tasks with exact sizes; the result states the invariants."""
    tasks = table(spark, sf, "tasks")
    groups = cc.components(tasks.select("task_id", F.explode(F.array(F.concat(F.lit("a"), "asin"), F.concat(F.lit("i"), F.md5(F.lower("instruction"))))).alias("k")), "task_id", "k")
    n = tasks.count()
    split = cc.split_tasks(groups, "task_id", {"test": n // 5, "val": n // 5}, "seed-1")
    by = split.groupBy("split").agg(F.count("*").alias("value"))
    broken = split.groupBy("component").agg(F.countDistinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("value"))
    lost = tasks.join(split, "task_id", "left_anti").agg(F.count("*").alias("value"))
    named = lambda df, rule: df.select(F.lit(rule).alias("rule"), "value")
    return named(split.agg(F.count("*").alias("value")), "tasks").unionByName(by.where("split <> 'rest'").select(F.concat("split", F.lit("_size")).alias("rule"), "value")).unionByName(named(broken, "split_groups")).unionByName(named(lost, "unassigned"))


@query("""with r as (select delivery_id, run_id, lower(trim(episode_id)) as e, delivered_at, status from traces where episode_id is not null),
s as (select *, coalesce(max((status = 'completed')::int) over (partition by run_id, e order by delivered_at nulls first, delivery_id rows between unbounded preceding and 1 preceding), 0) as before from r)
select run_id, count(*) filter (before = 1)::bigint as after_complete, count(*) filter (before = 1 and status = 'completed')::bigint as completed_again from s group by 1""")
def trace_violations(spark, sf):
    """Attempts after a completed one, and second completions; a strict reader raises if there are any."""
    r = table(spark, sf, "traces").where("episode_id is not null").select("delivery_id", "run_id", F.lower(F.regexp_replace("episode_id", r"^\s+|\s+$", "")).alias("e"), "delivered_at", "status")
    w = Window.partitionBy("run_id", "e").orderBy(F.col("delivered_at").asc_nulls_first(), "delivery_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col("status") == "completed").cast("int")).over(w), F.lit(0)) == 1
    return r.withColumn("b", done).groupBy("run_id").agg(F.count_if("b").alias("after_complete"), F.count_if(F.col("b") & (F.col("status") == "completed")).alias("completed_again"))


# Search documents -------------------------------------------------------------------------


@query("""select p_partkey, p_name || ' ' || p_brand || ' ' || p_type as body, 'finish ' || p_type || ' size ' || p_size as options from part""")
def search_documents(spark, sf):
    """A row's public fields as one search document; options as axes in order with their visible values."""
    options = tx.option_document(F.create_map(F.lit("size"), F.array(F.col("p_size").cast("string"), F.lit(" ")), F.lit("finish"), F.array("p_type")))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("body"), options.alias("options"))


@query("""with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[._+\\-/][a-z0-9]+)*') as t from documents where text is not null and regexp_full_match(text, '[\\x00-\\x7F]*'))
select doc_id, len(list_distinct(list_filter(t, lambda x: regexp_matches(x, '[a-z]') and regexp_matches(x, '[0-9]'))))::int as models from d""")
def model_numbers(spark, sf):
    """Model numbers of the texts in plain ASCII; a token has a letter and a digit."""
    d = table(spark, sf, "documents").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    own = F.filter(tx.model_numbers(F.col("text")), lambda x: x.rlike("[a-z]") & x.rlike("[0-9]"))
    return d.select("doc_id", F.size(own).alias("models"))


_HAN = """r as (select doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(lower(text), '人民币|块钱', '元', 'g'), '([0-9])\\s*(?:rmb|cny|yuan)\\b', '\\1元', 'g'), '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]+')) as r from documents where text is not null),
h as (select doc_id, case when length(r) = 1 then r else substr(r, i::bigint, 2) end as t from (select doc_id, r, unnest(range(1, greatest(length(r), 2))) as i from r))"""


@query(f"""with {_HAN} select doc_id, count(distinct t)::int as pairs, min(t) as first_pair from h group by 1""")
def han_pairs(spark, sf):
    """Pairs of neighbouring Han characters among a text's search tokens."""
    t = F.filter(rt.search_tokens(F.col("text")), lambda x: x.rlike("^[㐀-䶿一-鿿]"))
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.array_distinct(t).alias("t")).where("size(t) > 0")
    return rows.select("doc_id", F.size("t").alias("pairs"), F.array_min("t").alias("first_pair"))


@query("""select 'word' as mode, p_partkey from part where contains(p_name, 'ring') union all select 'type', p_partkey from part where p_type = 'ECONOMY'
union all (select 'random', p_partkey from part order by sha256('7:' || p_partkey), p_partkey limit 30)""")
def browse_modes(spark, sf):
    """A random page by hash, or all rows of an attribute word or a category."""
    p = table(spark, sf, "part")
    pick = p.orderBy(F.sha2(F.concat_ws(":", F.lit("7"), F.col("p_partkey").cast("string")), 256), "p_partkey").limit(30)
    mode = lambda df, name: df.select(F.lit(name).alias("mode"), "p_partkey")
    return mode(p.where(F.contains("p_name", F.lit("ring"))), "word").unionByName(mode(p.where("p_type = 'ECONOMY'"), "type")).unionByName(mode(pick, "random"))


# Dumps ------------------------------------------------------------------------------------


@query("""select event_id, event_type from ((select * from events order by event_id limit 250) union all (select * from events order by event_id desc limit 250))""")
def dump_halves(spark, sf):
    """A rollout's dump saved under a path template and read back, half from its head and half from its tail."""
    template = work_path(spark, "dump") + "-{rollout}"
    dumps.save_dump(table(spark, sf, "events"), template, 3)
    return dumps.load_dump(spark, template, 3, "event_id", 500).select("event_id", "event_type")


@query("""select doc_id, sha256(text) as digest, lang from documents where text is not null""")
def gzip_roundtrip(spark, sf):
    path = work_path(spark, "gzip")
    dumps.write_gzip_json(table(spark, sf, "documents").where("text is not null").select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id bigint, text string, lang string").json(path).select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


@query("""select true as equal, 1::bigint as kinds from (select 1)""")
def gzip_content_hashes(spark, sf):
    """Two sinks of the same rows have the same content hashes."""
    paths = [work_path(spark, "gzip") for _ in range(2)]
    for p in paths:
        dumps.write_gzip_json(table(spark, sf, "tasks").repartition(1).sortWithinPartitions("task_id"), p)
    a, b = (dumps.gzip_hashes(spark, f"{p}/*.gz").groupBy("sha256").count() for p in paths)
    return a.join(b, ["sha256", "count"], "full").agg((F.count("*") == F.max("count")).alias("equal"), F.count("*").alias("kinds"))


# Text rules on fixed cases -----------------------------------------------------------------

#: (rule, input, expected); fixed cases whose results follow from the rules.
CASES = [
    ("query", "  预算 300 RMB，蓝色", "预算 300元 蓝色"), ("query", "50块钱以内；耳机", "50元以内 耳机"), ("query", "ＡＢＣ-1/2 Mug!", "abc-1/2 mug"), ("query", "200yuan", "200元"), ("option", "Blue / Large ", "blue|large"),
    ("ratio", "Red-Mug large|large red, MUG", "100.0"), ("ratio", "red mug|red mug with lid", "100.0"), ("ratio", "abc|xyz", "0.0"), ("ratio", "abcd|abce", "75.0"), ("models", "Canon EOS-R5 and X100V, 2024", "eos-r5,x100v"),
    ("terms", "Mug A1 蓝色杯", "mug,a1,蓝色,色杯"), ("terms", "杯 x", "x,杯"), ("boxed", r"so \boxed{1} or \boxed{\frac{1}{2}}", r"\frac{1}{2}"), ("boxed", "none", None), ("tags", "<think>a</think><answer>b</answer>", "true"), ("tags", "<think><answer></answer></think>", "false"),
    ("answer", "<answer>x</answer> then <answer> y </answer>", "y"), ("answer", "<answer>x</answer>", None), ("letter", "The answer is (b)", "B"), ("letter", "I pick (C).", "C"), ("letter", "nothing", None), ("number", "$1,234.50", "1234.5"), ("number", "3.0", "3"),
    ("calls", '<tool_call name="open"><tool_call name="buy">', "open,buy"), ("verb", " search[red mug] ", "search"), ("verb", "open[1] then buy[2]", None), ("visible", "<p>Hi <script>x</script><b>you</b></p>", "Hi [SEP] you"), ("name", "a b/c:d", "a_b_c_d"),
    ("values", '{"b": 1, "a": [2, null]}', "2 1"), ("canonical", '{"b": 1, "a": "ü"}', '{"a":"ü","b":1}'), ("drop", '{"b": 1, "a": {"b": 2, "c": 3}}', '{"a": {"c": 3}}'),
]
_QUOTE = lambda s: "null" if s is None else "'" + s.replace("'", "''") + "'"


@query(f"select rule, input, expected as result from (values {', '.join(f'({_QUOTE(a)}, {_QUOTE(b)}, {_QUOTE(c)})' for a, b, c in CASES)}) v(rule, input, expected)")
def text_rules(spark, sf):
    t = F.col("input")
    side = lambda i: F.element_at(F.split(t, r"\|"), i)
    rules = {
        "query": tx.normal_query(t), "option": tx.option_text(t), "ratio": tx.token_set_ratio(side(1), side(-1)).cast("string"), "models": F.array_join(tx.model_numbers(t), ","), "terms": F.array_join(tx.title_terms(t), ","), "boxed": tx.last_boxed(t),
        "tags": tx.tags_in_order(t, ["think", "answer"]).cast("string"), "answer": tx.last_answer(t), "letter": tx.choice_letter(t), "number": tx.normal_number(t), "calls": F.array_join(tx.tool_calls(t), ","), "verb": tx.parse_action(t)[0], "visible": tx.visible_text(t),
        "name": tx.safe_name(t), "values": tx.flatten_values(t), "canonical": tx.canonical_json(t), "drop": tx.drop_keys(t, ["b"]),
    }
    result = F.lit(None).cast("string")
    for name, c in rules.items():
        result = F.when(F.col("rule") == name, c).otherwise(result)
    return spark.createDataFrame([c[:2] for c in CASES], "rule string, input string").select("rule", "input", result.alias("result"))


@query("""select p_partkey, case when p_size % 4 = 0 then 'color' end as valid, case when p_size % 4 in (1, 3) then 'color' end as missing, case when p_size % 4 = 2 then 'color' when p_size % 4 = 3 then 'shape' end as invalid from part""")
def option_states(spark, sf):
    """Axes that are chosen well, not chosen, or chosen with a value or axis that is not offered."""
    k = F.col("p_size") % 4
    chosen = F.when(k == 0, F.create_map(F.lit("color"), F.lit("red"))).when(k == 1, F.create_map().cast("map<string,string>")).when(k == 2, F.create_map(F.lit("color"), F.lit("pink"))).otherwise(F.create_map(F.lit("shape"), F.lit("round")))
    state = cat.option_state(chosen, F.create_map(F.lit("color"), F.array(F.lit("red"), F.lit("blue"))))
    join = lambda f: F.nullif(F.array_join(state[f], ","), F.lit(""))
    return table(spark, sf, "part").select("p_partkey", *(join(f).alias(f) for f in ("valid", "missing", "invalid")))


@query(r"""select id, case when not (contains(response, '</think>') or contains(response, '###Response')) then 0 when label = '' then 0 else (answer is not null and answer = label)::int end as reward
from (values (1, 'x</think> \boxed{4}', '4', '4'), (2, 'no marks \boxed{4}', '4', '4'), (3, '###Response \boxed{5}', '4', '5'), (4, 'a</think>\boxed{7}', '', '7'), (5, 'a</think>none', '7', null)) v(id, response, label, answer)""")
def rule_rewards(spark, sf):
    """Reward of a final boxed answer: only what follows the reasoning counts, an empty label never does."""
    rows = [(1, r"x</think> \boxed{4}", "4"), (2, r"no marks \boxed{4}", "4"), (3, r"###Response \boxed{5}", "4"), (4, r"a</think>\boxed{7}", ""), (5, "a</think>none", "7")]
    df = spark.createDataFrame(rows, "id int, response string, label string")
    told = F.when(F.contains("response", F.lit("</think>")), F.element_at(F.split("response", "</think>"), -1)).when(F.contains("response", F.lit("###Response")), F.try_element_at(F.split("response", "###Response"), F.lit(2)))
    same = tx.normal_number(tx.last_boxed(told)) == tx.normal_number(F.col("label"))
    return df.select("id", F.when(told.isNull() | (F.col("label") == ""), 0).otherwise(F.coalesce(same, F.lit(False)).cast("int")).alias("reward"))
