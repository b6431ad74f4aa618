"""Queries of the text operators and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import history_index, mixing, near_copies, packing, residue
from tracemill.session import Scratch, work_path, written
from tracemill.sources.tables import table


#: Lines that are taken in together: whole batches, one after another; a larger batch is an ingest of its own.
INGEST_LINES = 200_000


def _ingests(sizes: list[tuple[int | None, int]], most: int) -> list[list[int | None]]:
    """Batches (number, lines) in their order, those that follow each other together while they have at most ``most`` lines."""
    out: list[list[int | None]] = []
    held = 0
    for batch, n in sorted(sizes, key=lambda x: (x[0] is not None, x[0])):
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(batch)
        held += n
    return out


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """(ledger_row, accepted): the backlog goes into an index batch after batch, in ingests of up to INGEST_LINES lines."""
    columns = ["batch_no", "ledger_row", "candidate_id", "replacement_family_id", "content"]
    lines = table(spark, sf, "proposal_ledger").select(*columns)
    ingests = _ingests([tuple(r) for r in lines.groupBy("batch_no").count().collect()], INGEST_LINES)  # a row for each batch
    with Scratch(spark) as tmp:
        index = history_index.AcceptedIndex(spark, work_path(spark, "accepted"))
        if len(ingests) > 1:
            # Laid out by ingest once, so that each reads its own lines only.
            path, ends = tmp.path("arrived"), [group[-1] for group in ingests[:-1]]
            after = reduce(lambda x, y: x + y, [F.coalesce(F.col("batch_no") > F.lit(end), F.lit(end is None) & F.col("batch_no").isNotNull()).cast("int") for end in ends])
            lines.withColumn("ingest", after).write.partitionBy("ingest").parquet(path)
            lines = spark.read.schema(lines.withColumn("ingest", after).schema).parquet(path)
            parts = [lines.where(F.col("ingest") == i).drop("ingest") for i in range(len(ingests))]
        else:
            parts = [lines] * len(ingests)
        index.ingest(parts, ["batch_no", "ledger_row"], "ledger_row", "candidate_id", "replacement_family_id", "content")
    return index.judged().select(F.col("line").alias("ledger_row"), "accepted")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where("not accepted").select("ledger_row").distinct()


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    ledger, pool = table(spark, sf, "proposal_ledger"), table(spark, sf, "candidate_pool")
    return reduce(
        DataFrame.unionByName,
        [
            ledger.select(F.lit("proposal_ledger.content").alias("scope"), F.col("candidate_id").alias("id"), F.col("content").alias("text")),
            ledger.select(F.lit("proposal_ledger.failure_mechanism").alias("scope"), F.col("candidate_id").alias("id"), F.col("failure_mechanism").alias("text")),
            pool.select(F.lit("candidate_pool.content").alias("scope"), F.coalesce("skill_id", "candidate_id").alias("id"), F.col("content").alias("text")),
        ],
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as tmp:
        texts, members = near_copies.distinct_texts(_fields(spark, sf), tmp)
        return written(near_copies.like_ids(near_copies.like_texts(texts, tmp), members).withColumnRenamed("scope", "field_name"), "p5")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every (field, id, class of like texts) with the number of its text's links."""
    with Scratch(spark) as tmp:
        texts, members = near_copies.distinct_texts(_fields(spark, sf), tmp)
        links = near_copies.like_texts(texts, tmp)
        classes = near_copies.text_classes(texts, links, tmp)
        ends = links.select(F.col("a").alias("tid")).unionByName(links.select(F.col("b").alias("tid"))).groupBy("tid").agg(F.count("*").alias("links"))
        out = members.join(classes, "tid").join(ends, "tid", "left")
        return written(out.select(F.col("scope").alias("field_name"), "id", F.hex("class_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "p5")


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's tokens, counted once and written."""
    docs = table(spark, sf, "documents")
    # Long texts sit side by side in the files; spread, no task has them all.
    docs = docs.select("doc_id", "source", "text").repartition("doc_id")
    return written(docs.select("doc_id", "source", packing.token_count(F.col("text")).alias("tokens"), mixing.quality_weight(F.col("text")).alias("weight")), "sizes")


def p7_placed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf), table(spark, sf, "pack_sizes"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    packs = table(spark, sf, "pack_sizes")
    return packing.report(written(p7_placed(spark, sf), "placed"), packs)


def p8_chosen(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text").repartition("doc_id")
    return docs.where(residue.residue_kind(F.col("text")) != "").select("doc_id").distinct()


def p9_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with residue, by its kind."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text").repartition("doc_id")
    return docs.select("doc_id", residue.residue_kind(F.col("text")).alias("kind")).where("kind <> ''").groupBy("kind").agg(F.countDistinct("doc_id").alias("documents"))


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind of container: documents placed, and how often a rule is broken (overfull, overlapping, split without need, tokens lost)."""
    packs = table(spark, sf, "pack_sizes")
    sizes = _sizes(spark, sf)
    placed = written(packing.pack(sizes, packs), "placed")
    w = Window.partitionBy("pack_name", "shard", "container").orderBy("place")
    rows = placed.withColumn("expected", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(packs, "pack_name")
    bins = rows.groupBy("pack_name").agg(F.count_if(F.col("place") + F.col("tokens") > F.col("capacity_tokens")).alias("overfull"), F.count_if(F.col("place") != F.col("expected")).alias("misplaced"))
    docs = placed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("total")).join(packs, "pack_name").join(sizes.select("doc_id", F.col("tokens").alias("want")), "doc_id")
    docs = docs.groupBy("pack_name").agg(
        F.countDistinct("doc_id").alias("documents"), F.count_if(F.col("pieces") > F.ceil(F.col("want") / F.col("capacity_tokens"))).alias("split_needlessly"), F.count_if(F.col("total") != F.col("want")).alias("tokens_lost")
    )
    return docs.join(bins, "pack_name")


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per target source: usable documents, and whether repeats, budget and the order of epochs are kept."""
    targets = table(spark, sf, "mix_targets")
    sizes = _sizes(spark, sf)
    chosen, shares = mixing.mix(sizes, targets)
    longest = sizes.groupBy(mixing.source_name(F.col("source")).alias("source")).agg(F.max("tokens").alias("longest"))
    spread = chosen.groupBy("source").agg(F.max("repeats").alias("most"), F.min("repeats").alias("least"), F.count("*").alias("n"))
    docs = table(spark, sf, "documents").where("text <> ''").select(mixing.source_name(F.col("source")).alias("source"), "doc_id").distinct().groupBy("source").agg(F.count("*").alias("usable"))
    out = shares.join(spread, "source", "left").join(docs, "source", "left").join(longest, "source", "left")
    return out.select(
        "source", F.coalesce("usable", F.lit(0)).alias("usable"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("repeats_kept"), (F.col("used_tokens") <= F.col("budget")).alias("within_budget"),
        (F.col("budget") - F.col("used_tokens") <= F.coalesce("longest", F.lit(0))).alias("budget_filled"), F.coalesce((F.col("most") - F.col("least") <= 1) & ((F.col("most") == 1) | (F.col("n") == F.col("usable"))), F.lit(True)).alias("epochs_whole"),
    )


QUERIES = {f.__name__: f for f in (p1_found, p5_found, p5_groups, p7_placed, p7_report, p7_checks, p8_chosen, p8_shares, p8_checks, p9_found, p9_kinds)}

_PLAIN = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
#: Rows (k, g) of a text's distinct runs of five characters, and the pairs of like texts of one scope by the number of common runs.
_RUNS = "select distinct k, f, hash(substr(t, i::bigint, 5)) as g from (select k, f, t, unnest(range(1, length(t) - 3)) as i from {0} where length(t) >= 5)"
_LIKE = "n as (select k, count(*) as n from g group by 1), lk as materialized (select a, b from (select p.k as a, q.k as b, count(*) as c from g p join g q on p.g = q.g and p.f is not distinct from q.f and p.k < q.k group by 1, 2) join n na on na.k = a join n nb on nb.k = b where 5 * c >= 3 * (na.n + nb.n - c))"
_TEXTS = f"""
w as (select 'proposal_ledger.content' as scope, candidate_id as id, content as text from proposal_ledger
  union all select 'proposal_ledger.failure_mechanism', candidate_id, failure_mechanism from proposal_ledger
  union all select 'candidate_pool.content', coalesce(skill_id, candidate_id), content from candidate_pool),
m as (select distinct scope, id, {_PLAIN.format('text')} as t from w where id is not null and text is not null),
x as (select scope, t, row_number() over (order by scope, t) as k, scope as f from (select distinct scope, t from m where length(t) >= 5)),
g as ({_RUNS.format('x')}), {_LIKE},
mm as (select m.scope, m.id, x.k from m join x on m.scope = x.scope and m.t = x.t)
"""

ORACLE: dict[str, str] = {
    "p1_found": f"""with recursive l as (select *, row_number() over (order by batch_no nulls first, ledger_row) as rn, {_PLAIN.format("coalesce(content, '')")} as t from proposal_ledger),
x as (select rn as k, candidate_id, replacement_family_id as f, t from l), g as ({_RUNS.format('x')}), {_LIKE},
c as materialized (select b as rn, list(a) as earlier from (select a, b from lk union select p.k, q.k from x p join x q on p.k < q.k and p.candidate_id = q.candidate_id) group by 1),
s as (select 0::bigint as i, []::bigint[] as kept union all
  select i + 1, case when len(list_intersect(kept, coalesce(c.earlier, []::bigint[]))) = 0 then list_append(kept, i + 1) else kept end
  from s left join c on c.rn = s.i + 1 where i < (select max(rn) from l))
select ledger_row from l where rn not in (select unnest(kept) from s where i = (select max(i) from s))""",
    "p5_found": f"""with {_TEXTS}
select distinct scope as field_name, least(u, v) as id_a, greatest(u, v) as id_b from (
  select p.scope, p.id as u, q.id as v from lk join mm p on p.k = lk.a join mm q on q.k = lk.b where p.id <> q.id
  union all select p.scope, p.id, q.id from mm p join mm q on p.k = q.k and p.id < q.id)""",
    "p5_groups": f"""with recursive {_TEXTS},
e as (select a, b from lk union all select b, a from lk),
r as (select k as a, k as b from x where k in (select a from e) union select r.a, e.b from r join e on r.b = e.a),
d as (select k, upper(substr(sha256('["' || scope || '","' || t || '"]'), 1, 32)) as digest from x),
cl as (select x.k, coalesce(min(d2.digest), any_value(d1.digest)) as class_id from x join d d1 on d1.k = x.k left join r on r.a = x.k left join d d2 on d2.k = r.b group by 1)
select mm.scope as field_name, mm.id, cl.class_id, (select count(*) from e where e.a = mm.k)::bigint as links from mm join cl on cl.k = mm.k""",
    "p7_checks": """select pack_name, (select count(distinct doc_id) from documents where text <> '')::bigint as documents, 0::bigint as split_needlessly, 0::bigint as tokens_lost, 0::bigint as overfull, 0::bigint as misplaced from pack_sizes""",
    "p8_checks": r"""with d as (select regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') as source, count(distinct doc_id)::bigint as n from documents where text <> '' group by 1)
select regexp_replace(lower(trim(t.source)), '[\s_-]+', '_', 'g') as source, coalesce(d.n, 0)::bigint as usable, true as repeats_kept, true as within_budget, true as budget_filled, true as epochs_whole
from mix_targets t left join d on d.source = regexp_replace(lower(trim(t.source)), '[\s_-]+', '_', 'g')""",
}
