"""Queries of the general training-data operators (problems 2, 3, 4 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators import delivery, drift, history, nested
from tracemill.session import work_path, written
from tracemill.sources.tables import table

TRACE_LISTS = [
    nested.ListSpec("selected_skills", ("$.selected_skills",)),
    nested.ListSpec("steps", ("$.steps",)),
    nested.ListSpec("steps.environment.observation_state.hits", ("$.steps", "$.environment.observation_state.hits")),
]
CASE_LISTS = [nested.ListSpec("conditions.{}.actions", ("$.actions",), each_key=True)]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    c = drift.pool_log(table(spark, sf, "candidate_pool")).changes()
    return c.select(F.col("series").alias("run_id"), F.col("seq").alias("round_no"), "drift_kind", "old_field", "new_field")


def p2_union_types(spark: SparkSession, sf: str) -> DataFrame:
    return drift.pool_log(table(spark, sf, "candidate_pool")).union_types()


def p2_uniform(spark: SparkSession, sf: str) -> DataFrame:
    """All entries with the union schema's columns; the schema, a row per field, is the plan's input."""
    pool = table(spark, sf, "candidate_pool")
    fields = {r["field"]: r["union_type"] for r in drift.pool_log(pool).union_types().collect()}
    return drift.uniform_table(pool.drop("content"), "metadata", fields).drop("metadata")


def _drifting_files(spark: SparkSession, sf: str) -> list[str]:
    """lineitem as four files' worth of differing headers: widened, grown inside a struct, reordered, retyped, with fields gone and come."""
    l = table(spark, sf, "lineitem")
    info = lambda *names: F.struct(*(F.col({"flag": "l_returnflag", "status": "l_linestatus"}[n]).alias(n) for n in names)).alias("info")
    parts = [
        [F.col("l_orderkey").cast("int").alias("id"), F.col("l_quantity").alias("qty"), info("flag"), F.col("l_shipdate").cast("date").cast("string").alias("note")],
        [F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("int").alias("qty"), info("flag", "status"), F.lit("x").alias("note")],
        [info("status", "flag"), F.col("l_quantity").alias("qty"), F.col("l_orderkey").alias("id"), F.array(F.struct(F.col("l_linenumber").alias("a"))).alias("tags")],
        [F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("qty"), info("flag", "status"), F.col("l_linenumber").alias("note"), F.array(F.struct(F.col("l_partkey").alias("a"), F.lit("k").alias("b"))).alias("tags")],
    ]
    files = []
    for k, columns in enumerate(parts):
        path = work_path(spark, "drift")
        l.where(F.col("l_linenumber") % 4 == k).select(*columns).coalesce(2).write.parquet(path)
        files += sorted(spark.read.parquet(path).inputFiles())
    return files


def p2_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of drifting headers read as one table."""
    df, _ = drift.scan_drifting_parquet(spark, _drifting_files(spark, sf))
    tag = F.try_element_at("tags", F.lit(1))
    return df.select("id", "qty", "info.flag", "info.status", "note", tag["a"].alias("tag_a"), tag["b"].alias("tag_b"))


def p2_file_log(spark: SparkSession, sf: str) -> DataFrame:
    """What changed from one file to the next."""
    _, log = drift.scan_drifting_parquet(spark, _drifting_files(spark, sf))
    return log.select("kind", "field", "detail").distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    dim = history.scd2_merge(None, history.skillbank_states(table(spark, sf, "selected_skillbank")))
    return dim.select(F.col("scope").alias("run_id"), F.col("entity").alias("skill_id"), "first_snapshot", "last_snapshot")


def p3_merged(spark: SparkSession, sf: str) -> DataFrame:
    """As p3_found, from a store that takes the snapshots in one after another."""
    states = written(history.skillbank_states(table(spark, sf, "selected_skillbank")), "states")
    store = history.HistoryStore(spark, work_path(spark, "history"))
    for (no,) in sorted(states.select("snapshot_no").distinct().collect()):  # a row for each snapshot number
        store.merge(states.where(F.col("snapshot_no") == no))
    return store.versions().select(F.col("scope").alias("run_id"), F.col("entity").alias("skill_id"), "first_snapshot", "last_snapshot")


def p3_current(spark: SparkSession, sf: str) -> DataFrame:
    """The open versions: those that hold in their run's newest snapshot."""
    dim = history.scd2_merge(None, history.skillbank_states(table(spark, sf, "selected_skillbank")))
    return dim.where("last_snapshot = scope_last").select(F.col("scope").alias("run_id"), F.col("entity").alias("skill_id"), "first_snapshot")


def _delivered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(rows to use, surplus): the batches of one number, of all runs together, are one ingest; numbers go in order."""
    rows = table(spark, sf, "traces").select("delivery_id", "run_id", "episode_id", "delivered_at", "batch_id")
    number = F.regexp_extract(F.coalesce("batch_id", F.lit("")), r"(\d*)$", 1)
    rows = rows.withColumn("batch_no", number)
    store = delivery.SeenStore(spark, work_path(spark, "seen"))
    for (no,) in sorted(rows.select("batch_no").distinct().collect()):  # a row for each number
        store.ingest(rows.where(F.col("batch_no") == no), delivery.episode_key(), "delivery_id", ["delivered_at"])
    return delivery.split_arrivals(rows.drop("batch_no", "batch_id"), store.holders("delivery_id"), delivery.episode_key(), "delivery_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _delivered(spark, sf)[1]


def p4_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Per run the surplus copies found, beside the figure its replay index states."""
    rows = table(spark, sf, "traces").select("delivery_id", "run_id")
    surplus = _delivered(spark, sf)[1].withColumn("surplus", F.lit(1))
    found = rows.join(surplus, "delivery_id", "left").groupBy("run_id").agg(F.count("*").alias("records"), F.count("surplus").alias("duplicate_records"))
    stated = table(spark, sf, "replay").select("run_id", F.col("duplicate_records").alias("stated_duplicates"))
    return found.join(stated, "run_id", "left").withColumn("stale", ~F.col("duplicate_records").eqNullSafe(F.col("stated_duplicates")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    t = nested.list_elements(table(spark, sf, "traces"), "delivery_id", "trace", TRACE_LISTS, keep_value=False)
    c = nested.list_elements(table(spark, sf, "cases"), "case_id", "conditions", CASE_LISTS, keep_value=False)
    v = nested.native_elements(table(spark, sf, "proposal_ledger"), "ledger_row", "validation_history")
    named = lambda df, name, key: df.select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "array_path", "pos1", "pos2")
    return named(t, "traces", "delivery_id").unionByName(named(c, "cases", "case_id")).unionByName(named(v, "proposal_ledger", "ledger_row"))


def p6_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as a flat table that joins to p6_steps on (delivery_id, pos1)."""
    fields = {"asin": ("$.asin", "string"), "hit_rank": ("$.rank", "int"), "price": ("$.price", "double")}
    return nested.child_table(table(spark, sf, "traces"), "delivery_id", "trace", TRACE_LISTS[2], fields)


def p6_steps(spark: SparkSession, sf: str) -> DataFrame:
    fields = {
        "action": ("$.action", "string"),
        "total_tokens": ("$.model.usage.total_tokens", "bigint"),
        "valid": ("$.environment.action_feedback.valid", "boolean"),
        "page_type": ("$.environment.observation_state.page_type", "string"),
    }
    return nested.child_table(table(spark, sf, "traces"), "delivery_id", "trace", TRACE_LISTS[1], fields)


def p6_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = nested.native_elements(table(spark, sf, "proposal_ledger"), "ledger_row", "validation_history")
    return rows.select("ledger_row", "pos1", "element.proposal_checkpoint", "element.evaluation_checkpoint", "element.intervention_id", F.round("element.estimated_effect", 6).alias("estimated_effect"))


def episode_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Per delivery its steps, invalid ones, searches and token totals; a delivery without steps has no row."""
    rows = p6_steps(spark, sf)
    return rows.groupBy("delivery_id").agg(
        F.count("*").alias("steps"), F.count_if(F.col("valid") == False).alias("invalid"), F.count_if(F.col("action").startswith("search[")).alias("searches"),  # noqa: E712
        F.sum("total_tokens").alias("tokens"), F.round(F.try_divide(F.sum("total_tokens").cast("double"), F.count("total_tokens")), 6).alias("tokens_per_step"),
    )


def page_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """How often one page type follows another within a delivery."""
    w = Window.partitionBy("delivery_id").orderBy("pos1")
    rows = p6_steps(spark, sf).where("page_type is not null").withColumn("before", F.lag("page_type").over(w)).where("before is not null")
    return rows.groupBy(F.concat_ws("->", "before", "page_type").alias("transition")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (episode_rollup, page_transitions, p2_found, p2_union_types, p2_uniform, p2_files, p2_file_log, p3_found, p3_merged, p3_current, p4_found, p4_replay, p6_found, p6_hits, p6_steps, p6_history)}

_STATES = """
r as (select run_id, skill_id, snapshot_no, version, enabled,
        trim(regexp_replace(content, '[\\s\\x{85}\\x{a0}\\x{3000}]+', ' ', 'g')) as c,
        row_number() over (partition by run_id, skill_id, snapshot_no order by ingested_at desc nulls last, bank_row desc) rn
      from selected_skillbank where snapshot_no is not null),
o as (select run_id, snapshot_no, row_number() over (partition by run_id order by snapshot_no) ord, max(snapshot_no) over (partition by run_id) top
      from (select distinct run_id, snapshot_no from selected_skillbank where snapshot_no is not null)),
s as (select r.*, o.ord, o.top from r join o on r.run_id is not distinct from o.run_id and r.snapshot_no = o.snapshot_no where rn = 1),
l as (select *, lag(ord) over w po, lag(version) over w pv, lag(enabled) over w pe, lag(c) over w pc from s window w as (partition by run_id, skill_id order by ord)),
v as (select *, sum(case when po = ord - 1 and pv is not distinct from version and pe is not distinct from enabled and pc is not distinct from c then 0 else 1 end)
        over (partition by run_id, skill_id order by ord rows unbounded preceding) as g from l),
p as (select run_id, skill_id, g, min(snapshot_no) as first_snapshot, max(snapshot_no) as last_snapshot, max(top) as top from v group by all)
"""

_COPIES = """
k as (select delivery_id, run_id, delivered_at, lower(trim(episode_id)) as e from traces),
d as (select delivery_id, run_id, case when e is null then 1 else row_number() over (partition by run_id, e order by delivered_at desc nulls last, delivery_id desc) end as rn from k)
"""

_AS_LIST = """case when {v} is null or json_type({v}) = 'NULL' then null when json_type({v}) = 'ARRAY' then {v}
 when json_type({v}) = 'VARCHAR' and json_valid({v}->>'$') and json_type(({v}->>'$')::json) = 'ARRAY' then ({v}->>'$')::json
 else json_array({v}) end"""

_TRACES = f"""
t as (select delivery_id, trace::json as j from traces where json_valid(trace)),
sl as (select delivery_id, {_AS_LIST.format(v="(j->'$.steps')")} as a from t),
st as (select delivery_id, pos1, json_extract(a, '$[' || pos1 || ']') as s from (select delivery_id, a, unnest(range(json_array_length(a)::bigint)) as pos1 from sl where a is not null)),
hl as (select delivery_id, pos1, {_AS_LIST.format(v="(s->'$.environment.observation_state.hits')")} as a from st),
hi as (select delivery_id, pos1, pos2, json_extract(a, '$[' || pos2 || ']') as s from (select delivery_id, pos1, a, unnest(range(json_array_length(a)::bigint)) as pos2 from hl where a is not null)),
kl as (select delivery_id, {_AS_LIST.format(v="(j->'$.selected_skills')")} as a from t),
ks as (select delivery_id, pos1, json_extract(a, '$[' || pos1 || ']') as s from (select delivery_id, a, unnest(range(json_array_length(a)::bigint)) as pos1 from kl where a is not null))
"""

_CELLS = """
c as (select run_id, round_no, pool_row, coalesce(skill_id, candidate_id) as entry, unnest(json_keys(metadata::json)) as field, metadata::json as j
      from candidate_pool where json_valid(metadata) and json_type(metadata::json) = 'OBJECT'),
v as (select run_id, round_no, pool_row, entry, field, json_extract(j, '/' || field) as val from c),
w as (select *, case json_type(val) when 'NULL' then 0 when 'VARCHAR' then 1 when 'BOOLEAN' then 4 when 'ARRAY' then 8 when 'OBJECT' then 16 else 2 end as bit from v),
f as (select run_id, round_no, field, bit_or(bit) as mask from w group by all),
n as (select run_id, round_no, lag(round_no) over (partition by run_id order by round_no) as prev from (select distinct run_id, round_no from candidate_pool)),
side as (select n.run_id, n.round_no, f.field, max(case when f.round_no = n.round_no then 1 else 0 end) as is_new, max(case when f.round_no = n.prev then 1 else 0 end) as is_old
         from n join f on f.run_id = n.run_id and f.round_no in (n.round_no, n.prev) where n.prev is not null group by all)
"""

_STEPS = f"""{_TRACES}, sp as (select delivery_id, pos1, s->>'$.action' as action, try_cast(s->>'$.model.usage.total_tokens' as bigint) as tokens,
 try_cast(s->>'$.environment.action_feedback.valid' as boolean) as valid, s->>'$.environment.observation_state.page_type' as page_type from st where json_type(s) <> 'NULL')"""

ORACLE = {
    "episode_rollup": f"""with {_STEPS} select delivery_id, count(*)::bigint as steps, count(*) filter (valid = false)::bigint as invalid, count(*) filter (starts_with(action, 'search['))::bigint as searches,
sum(tokens)::bigint as tokens, round(sum(tokens)::double / nullif(count(tokens), 0), 6) as tokens_per_step from sp group by 1""",
    "page_transitions": f"""with {_STEPS}, l as (select page_type, lag(page_type) over (partition by delivery_id order by pos1) as before from sp where page_type is not null)
select before || '->' || page_type as transition, count(*)::bigint as n from l where before is not null group by 1""",
    "p2_found": f"""with {_CELLS},
e as (select run_id, round_no, entry, field, case when json_type(val) = 'NULL' then null else val::varchar end as val from w
      where entry is not null qualify rank() over (partition by run_id, round_no, entry order by pool_row desc) = 1),
o as (select n.run_id, n.round_no, e.entry, e.field, e.val from e join n on n.run_id = e.run_id and n.prev = e.round_no
      where e.val is not null and exists (select 1 from side s where s.run_id = n.run_id and s.round_no = n.round_no and s.field = e.field and s.is_new = 0)
        and exists (select 1 from e e2 where e2.run_id = n.run_id and e2.round_no = n.round_no and e2.entry = e.entry)),
tot as (select run_id, round_no, field, count(*) as n from o group by all),
hit as (select o.run_id, o.round_no, o.field as old_field, e.field as new_field, count(*) as hits from o join e on e.run_id = o.run_id and e.round_no = o.round_no and e.entry = o.entry and e.val = o.val
        where exists (select 1 from side s where s.run_id = o.run_id and s.round_no = o.round_no and s.field = e.field and s.is_old = 0) group by all),
ren as (select hit.run_id, hit.round_no, old_field, new_field from hit join tot on tot.run_id = hit.run_id and tot.round_no = hit.round_no and tot.field = old_field where tot.n >= 3 and hits >= 0.75 * tot.n),
lf as (select f.*, coalesce((select min(1 - s.is_old) from side s where s.run_id = f.run_id and s.round_no = f.round_no and s.field = f.field), 1) as born from f),
lg as (select *, sum(born) over (partition by run_id, field order by round_no rows unbounded preceding) as life from lf),
lm as (select *, last_value(case when mask > 0 then mask end ignore nulls) over (partition by run_id, field, life order by round_no rows between unbounded preceding and 1 preceding) as lastm from lg)
select run_id, round_no, 'renamed' as drift_kind, old_field, new_field from ren
union all select run_id, round_no, 'removed', field, '' from side s where is_new = 0 and not exists (select 1 from ren where ren.run_id = s.run_id and ren.round_no = s.round_no and ren.old_field = s.field)
union all select run_id, round_no, 'added', '', field from side s where is_old = 0 and not exists (select 1 from ren where ren.run_id = s.run_id and ren.round_no = s.round_no and ren.new_field = s.field)
union all select run_id, round_no, 'retyped', field, field from lm where mask > 0 and lastm is not null and lastm <> mask""",
    "p2_union_types": f"""with {_CELLS}
select field, case bit_or(mask) when 0 then 'void' when 1 then 'string' when 2 then 'number' when 4 then 'boolean' when 8 then 'array' when 16 then 'object' else 'string' end as union_type from f group by field""",
    "p2_files": """select l_orderkey as id, l_quantity as qty, l_returnflag as flag, case when l_linenumber % 4 > 0 then l_linestatus end as status,
case l_linenumber % 4 when 0 then strftime(l_shipdate, '%Y-%m-%d') when 1 then 'x' when 3 then l_linenumber::varchar end as note, case l_linenumber % 4 when 2 then l_linenumber::bigint when 3 then l_partkey end as tag_a, case when l_linenumber % 4 = 3 then 'k' end as tag_b from lineitem""",
    "p2_file_log": """select * from (values ('retyped', 'id', 'int -> bigint'), ('retyped', 'qty', 'double -> int'), ('retyped', 'info', 'struct<flag:string> -> struct<flag:string,status:string>'),
('retyped', 'info', 'struct<flag:string,status:string> -> struct<status:string,flag:string>'), ('retyped', 'qty', 'int -> double'), ('removed', 'note', ''), ('added', 'tags', 'array<struct<a:int>>'),
('retyped', 'info', 'struct<status:string,flag:string> -> struct<flag:string,status:string>'), ('added', 'note', 'int'), ('retyped', 'tags', 'array<struct<a:int>> -> array<struct<a:bigint,b:string>>')) v(kind, field, detail)""",
    "p3_found": f"with {_STATES} select run_id, skill_id, first_snapshot, last_snapshot from p",
    "p3_merged": f"with {_STATES} select run_id, skill_id, first_snapshot, last_snapshot from p",
    "p3_current": f"with {_STATES} select run_id, skill_id, first_snapshot from p where last_snapshot = top",
    "p4_found": f"with {_COPIES} select delivery_id from d where rn > 1",
    "p4_replay": f"""with {_COPIES},
a as (select run_id, count(*)::bigint as records, count(*) filter (rn > 1)::bigint as duplicate_records from d group by 1)
select a.*, r.duplicate_records as stated_duplicates, a.duplicate_records is distinct from r.duplicate_records as stale from a left join replay r on r.run_id = a.run_id""",
    "p6_found": f"""with {_TRACES},
cm as (select case_id, conditions::json as j, unnest(json_keys(conditions::json)) as name from cases where json_valid(conditions) and json_type(conditions::json) = 'OBJECT'),
cl as (select case_id, name, {_AS_LIST.format(v="(json_extract(j, '/' || name)->'$.actions')")} as a from cm),
ca as (select case_id, name, pos1, json_extract(a, '$[' || pos1 || ']') as s from (select case_id, name, a, unnest(range(json_array_length(a)::bigint)) as pos1 from cl where a is not null)),
vh as (select ledger_row, validation_history as h, unnest(range(len(validation_history))) as pos1 from proposal_ledger where validation_history is not null),
al as (select 'traces' as table_name, delivery_id as row_id, 'steps' as array_path, pos1, -1 as pos2 from st where json_type(s) <> 'NULL'
 union all select 'traces', delivery_id, 'selected_skills', pos1, -1 from ks where json_type(s) <> 'NULL'
 union all select 'traces', delivery_id, 'steps.environment.observation_state.hits', pos1, pos2 from hi where json_type(s) <> 'NULL'
 union all select 'cases', case_id, 'conditions.' || name || '.actions', pos1, -1 from ca where json_type(s) <> 'NULL'
 union all select 'proposal_ledger', ledger_row, 'validation_history', pos1, -1 from vh where h[pos1 + 1] is not null)
select table_name, row_id, array_path, pos1::int as pos1, pos2::int as pos2 from al""",
    "p6_history": """select ledger_row, pos1::int as pos1, e.proposal_checkpoint, e.evaluation_checkpoint, e.intervention_id, round(e.estimated_effect, 6) as estimated_effect
from (select ledger_row, unnest(validation_history) as e, generate_subscripts(validation_history, 1) - 1 as pos1 from proposal_ledger where len(validation_history) > 0) where e is not null""",
    "p6_hits": f"""with {_TRACES} select delivery_id, pos1::int as pos1, pos2::int as pos2, s->>'$.asin' as asin, try_cast(s->>'$.rank' as int) as hit_rank, try_cast(s->>'$.price' as double) as price from hi where json_type(s) <> 'NULL'""",
    "p6_steps": f"""with {_TRACES} select delivery_id, pos1::int as pos1, s->>'$.action' as action, try_cast(s->>'$.model.usage.total_tokens' as bigint) as total_tokens,
try_cast(s->>'$.environment.action_feedback.valid' as boolean) as valid, s->>'$.environment.observation_state.page_type' as page_type from st where json_type(s) <> 'NULL'""",
}
