"""Schemas that drift between files: one table, and a log of every change.

Two kinds of input:

* ``scan_drifting_parquet``: Parquet files with differing schemas. Footers are
  read by the executors, folded through the type lattice, and files of equal
  schema are read together and cast to the union schema.
* ``FieldLog`` over JSON objects that carry the drifting fields, a file being
  named by (series, sequence number).

The type lattice is a set of JSON types kept as a bit mask; its join is a bitwise
OR, which is associative and commutative, so the fold is a partial aggregate.
``promoted`` names the narrowest type that holds a mask.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.common import global_rank
from tracemill.operators.nested import absent, strict_json
from tracemill.session import written

#: Bit of each JSON type (fixed values).
TYPE_BITS = {"string": 1, "number": 2, "boolean": 4, "array": 8, "object": 16}
#: A rename needs so many shared entries, and this share of them with equal values.
RENAME_ENTRIES, RENAME_SHARE = 3, 0.75


def json_type(text: Column) -> Column:
    """JSON type name of a value's canonical JSON text; NULL for null."""
    head = F.substring(text, 1, 1)
    return (
        F.when(head == '"', "string")
        .when(head.isin("t", "f"), "boolean")
        .when(head == "[", "array")
        .when(head == "{", "object")
        .when(text.isNotNull() & (text != "null"), "number")
    )


def type_bit(kind: Column) -> Column:
    return reduce(lambda c, x: c.when(kind == x[0], x[1]), TYPE_BITS.items(), F.when(kind.isNull(), 0))


def promoted(mask: Column) -> Column:
    """The narrowest type for a set of JSON types: one type itself, mixtures as string."""
    return reduce(lambda c, x: c.when(mask == x[1], x[0]), TYPE_BITS.items(), F.when(mask == 0, "void")).otherwise("string")


@dataclass
class FieldLog:
    """Changes between the successive files of each series.

    ``cells`` has series, seq, entry, row_no, field, value (digest of the canonical
    JSON text, NULL for null) and bit, a row for every member of every valid record;
    ``files`` has series, seq of every file, also of those without a valid record.

    Defined results: a file exists when any row of it exists; rows whose record is
    null, torn or no object are left out; of an entry's repeated rows in one file the
    one with the largest row_no that is valid holds; a null entry never takes part
    in a rename; a file without non-null values of a field says nothing of its type.
    """

    cells: DataFrame
    files: DataFrame

    def fields(self) -> DataFrame:
        """series, seq, field, mask: the schema of each file, folded by partial aggregates."""
        return self.cells.groupBy("series", "seq", "field").agg(F.bit_or("bit").alias("mask"))

    def chain(self) -> DataFrame:
        """series, prev_seq, seq of neighbouring files."""
        w = Window.partitionBy("series").orderBy("seq")
        return self.files.distinct().withColumn("prev_seq", F.lag("seq").over(w)).where("prev_seq is not null")

    def changes(self) -> DataFrame:
        """series, seq, drift_kind, old_field, new_field."""
        # Tables of a row for each field or file are written: many branches read them.
        fields, chain = written(self.fields(), "fields"), written(self.chain(), "chain")
        later = chain.withColumnRenamed("prev_seq", "_p")
        new = fields.join(chain, ["series", "seq"]).select("series", "seq", "field", F.lit(1).alias("is_new"), F.lit(0).alias("is_old"))
        nxt = later.select("series", F.col("_p").alias("seq"), F.col("seq").alias("next_seq"))
        old = fields.join(nxt, ["series", "seq"]).select("series", F.col("next_seq").alias("seq"), "field", F.lit(0).alias("is_new"), F.lit(1).alias("is_old"))
        sides = written(new.unionByName(old).groupBy("series", "seq", "field").agg(F.max("is_new").alias("n"), F.max("is_old").alias("o")), "sides")
        gone = sides.where("n = 0").select("series", "seq", F.col("field").alias("old_field"))
        came = sides.where("o = 0").select("series", "seq", F.col("field").alias("new_field"))
        renamed = written(self._renames(gone, came, chain), "renamed")
        removed = gone.join(renamed, ["series", "seq", "old_field"], "left_anti").withColumn("new_field", F.lit(""))
        added = came.join(renamed, ["series", "seq", "new_field"], "left_anti").withColumn("old_field", F.lit(""))
        kind = lambda df, name: df.select("series", "seq", F.lit(name).alias("drift_kind"), "old_field", "new_field")
        return kind(renamed, "renamed").unionByName(kind(removed, "removed")).unionByName(kind(added, "added")).unionByName(kind(self._retypes(fields, sides), "retyped"))

    def _renames(self, gone: DataFrame, came: DataFrame, chain: DataFrame) -> DataFrame:
        # Only neighbours that lost and gained fields matter, and of their cells only those fields'.
        both = gone.select("series", "seq").distinct().join(came.select("series", "seq").distinct(), ["series", "seq"])
        steps = chain.join(both, ["series", "seq"])
        files = steps.select("series", "seq").unionByName(steps.select("series", F.col("prev_seq").alias("seq"))).distinct()
        cells = self.cells.where("entry is not null").join(files, ["series", "seq"], "left_semi")
        holds = written(cells.groupBy("series", "seq", "entry").agg(F.max("row_no").alias("row_no")), "holds")
        holding = ["series", "seq", "entry", "row_no"]
        # Values of vanished fields by entry, moved to the later file's number, where the entry exists in both.
        lost = gone.join(steps, ["series", "seq"]).select("series", F.col("prev_seq").alias("seq"), F.col("old_field").alias("field"), F.col("seq").alias("next_seq"))
        before = (
            cells.where("value is not null")
            .join(lost, ["series", "seq", "field"])
            .join(holds, holding, "left_semi")
            .select("series", F.col("next_seq").alias("seq"), "entry", F.col("field").alias("old_field"), F.col("value").alias("old_value"))
            .join(holds.select("series", "seq", "entry"), ["series", "seq", "entry"], "left_semi")
            .distinct()
        )
        totals = before.groupBy("series", "seq", "old_field").agg(F.count("*").alias("n"))
        gained = came.join(both, ["series", "seq"], "left_semi").select("series", "seq", F.col("new_field").alias("field"))
        after = cells.where("value is not null").join(gained, ["series", "seq", "field"], "left_semi").join(holds, holding, "left_semi")
        after = after.select("series", "seq", "entry", F.col("field").alias("new_field"), F.col("value").alias("old_value")).distinct()
        # Equality on the value: only agreeing pairs of fields come out of the join.
        hits = before.join(after, ["series", "seq", "entry", "old_value"]).groupBy("series", "seq", "old_field", "new_field").agg(F.count("*").alias("hits"))
        ok = (F.col("n") >= RENAME_ENTRIES) & (F.col("hits") >= RENAME_SHARE * F.col("n"))
        return hits.join(totals, ["series", "seq", "old_field"]).where(ok).select("series", "seq", "old_field", "new_field")

    def _retypes(self, fields: DataFrame, sides: DataFrame) -> DataFrame:
        # A field's life ends where a file lacks it: number the lives, then compare with the last known mask.
        born = sides.select("series", "seq", "field", (F.col("o") == 0).cast("int").alias("born"), "n").where("n = 1").drop("n")
        lives = fields.join(born, ["series", "seq", "field"], "left")
        w = Window.partitionBy("series", "field").orderBy("seq")
        lives = lives.withColumn("life", F.sum(F.coalesce("born", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        v = Window.partitionBy("series", "field", "life").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        last = F.last(F.when(F.col("mask") > 0, F.col("mask")), ignorenulls=True).over(v)
        return lives.withColumn("last", last).where("mask > 0 and last is not null and mask <> last").select("series", "seq", F.col("field").alias("old_field"), F.col("field").alias("new_field"))

    def union_types(self) -> DataFrame:
        """field, union_type: the lattice folded over all files."""
        return self.cells.groupBy("field").agg(F.bit_or("bit").alias("mask")).select("field", promoted(F.col("mask")).alias("union_type"))


def field_cells(df: DataFrame, series: str, seq: str, entry: Column, row_no: str, record: str) -> FieldLog:
    """Members of each row's JSON object as a FieldLog."""
    base = df.select(F.col(series).alias("series"), F.col(seq).alias("seq"), entry.alias("entry"), F.col(row_no).alias("row_no"), F.col(record).alias("record"))
    base = base.where("series is not null and seq is not null")
    members = F.map_entries(F.try_variant_get(strict_json(F.col("record")), "$", "map<string,variant>"))
    cells = base.select("series", "seq", "entry", "row_no", F.explode(members).alias("m")).select(
        "series", "seq", "entry", "row_no", F.col("m.key").alias("field"), F.when(~absent(F.col("m.value")), F.to_json("m.value")).alias("value")
    )
    # Parsed once: every later step reads the written members, not the records.
    cells = cells.withColumn("bit", type_bit(json_type(F.col("value")))).withColumn("value", F.unhex(F.md5("value")))
    cells = written(cells, "cells")
    return FieldLog(cells, base.select("series", "seq"))


def pool_log(pool: DataFrame) -> FieldLog:
    """FieldLog of candidate_pool.metadata: series run_id, seq round_no."""
    return field_cells(pool, "run_id", "round_no", F.coalesce("skill_id", "candidate_id"), "pool_row", "metadata")


def uniform_table(df: DataFrame, record: str, fields: dict[str, str]) -> DataFrame:
    """``df`` with a column for each field of the union schema, cast to its union type.

    ``fields`` is field -> union type (number, boolean, string, array, object,
    void); new columns are named ``<record>.<field>`` with an underscore, so they
    can't clash with ``df``'s. Mixtures, arrays and objects are JSON text.
    """
    v = strict_json(F.col(record))
    cols = {}
    for field, kind in sorted(fields.items()):
        member = F.try_element_at(F.col("_members"), F.lit(field))
        if kind == "number":
            c = F.try_variant_get(member, "$", "double")
        elif kind == "boolean":
            c = F.try_variant_get(member, "$", "boolean")
        else:
            # A string is its own text; anything else is its JSON text.
            c = F.when(~absent(member), F.try_variant_get(member, "$", "string")) if kind == "string" else F.when(~absent(member), F.to_json(member))
        cols[f"{record}_{field}"] = c
    return df.withColumn("_members", F.try_variant_get(v, "$", "map<string,variant>")).withColumns(cols).drop("_members")


# Parquet files ------------------------------------------------------------------

#: Whole numbers by width, with the decimal digits that hold them.
_WHOLE = {"byte": (1, 3), "short": (2, 5), "integer": (3, 10), "long": (4, 20)}


def join_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds the values of both; string at the top.

    Whole numbers widen, and join decimals as decimals; a float or double holds whole
    numbers up to int, but a long or decimal beside it needs text, since neither holds the
    other exactly. Structs join field by field, arrays and maps by their elements.
    """
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return join_schemas(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(join_types(a.elementType, b.elementType), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, join_types(a.valueType, b.valueType), True)
    names = {a.typeName(), b.typeName()}
    if names <= set(_WHOLE):
        return a if _WHOLE[a.typeName()] > _WHOLE[b.typeName()] else b
    if names <= {*_WHOLE, "decimal"}:
        whole, scale = (max(f(x) for x in (a, b)) for f in (_whole_digits, lambda x: x.scale if isinstance(x, T.DecimalType) else 0))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if names <= {"byte", "short", "float"}:
        return T.FloatType()
    if names <= {"byte", "short", "integer", "float", "double"}:
        return T.DoubleType()
    if names == {"date", "timestamp"}:
        return T.TimestampType()
    return T.StringType()


def _whole_digits(t: T.DataType) -> int:
    return t.precision - t.scale if isinstance(t, T.DecimalType) else _WHOLE[t.typeName()][1]


def cast_to(c: Column, a: T.DataType, b: T.DataType) -> Column:
    """A value of type ``a`` as its joined type ``b``: structs by field name, arrays and maps by element, anything else as text where ``b`` is a string."""
    if a == b:
        return c
    if isinstance(b, T.StructType) and isinstance(a, T.StructType):
        have = {f.name: f.dataType for f in a}
        fields = [(cast_to(c[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in b]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(b, T.ArrayType) and isinstance(a, T.ArrayType):
        return F.transform(c, lambda x: cast_to(x, a.elementType, b.elementType))
    if isinstance(b, T.MapType) and isinstance(a, T.MapType):
        return F.transform_values(c, lambda _, v: cast_to(v, a.valueType, b.valueType))
    if isinstance(b, T.StringType) and isinstance(a, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast(b)


def _reads_as(a: T.DataType, b: T.DataType) -> bool:
    """Whether a file's type ``a`` can be read with ``b`` directly: the same types, but for fields that it lacks."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return all(f.name in b.names and _reads_as(f.dataType, b[f.name].dataType) for f in a)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _reads_as(a.elementType, b.elementType)
    return a == b


def join_schemas(a: T.StructType, b: T.StructType) -> T.StructType:
    """Union of fields by name, in order of first appearance, types joined."""
    names = dict.fromkeys([*a.names, *b.names])
    pick = lambda n: join_types(a[n].dataType, b[n].dataType) if n in a.names and n in b.names else (a if n in a.names else b)[n].dataType
    return T.StructType([T.StructField(n, pick(n), True) for n in names])


def _footers(batches):
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs
    from pyspark.sql.pandas.types import from_arrow_schema

    for batch in batches:
        out = []
        for path in batch["path"]:
            try:
                system, inner = pafs.FileSystem.from_uri(path)
                out.append((path, from_arrow_schema(pq.read_schema(inner, filesystem=system)).json(), None))
            except Exception as e:  # noqa: BLE001
                out.append((path, None, f"{type(e).__name__}: {e}"[:300]))
        yield pd.DataFrame(out, columns=["path", "schema", "problem"])


def parquet_footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """place (in the list), path, schema (JSON), problem, read by the executors."""
    files = spark.createDataFrame([(i, p if "://" in p else f"file://{p}") for i, p in enumerate(paths)], "place bigint, path string")
    files = files.repartition(max(1, min(len(paths), 1024)))
    found = files.select("path").mapInPandas(_footers, "path string, schema string, problem string").distinct()
    return files.join(found, "path")


def _differences(pairs):
    """(place, path, kind, field, detail) for pairs of a file's schema and the one before."""
    for batch in pairs:
        out = []
        for place, path, before, now, problem in batch[["place", "path", "before", "schema", "problem"]].itertuples(index=False):
            if now is None:
                out.append((place, path, "unreadable", "", problem))
                continue
            old, new = ({f["name"]: T.StructType.fromJson({"type": "struct", "fields": [f]})[0].dataType for f in json.loads(s)["fields"]} for s in (before, now))
            out += [(place, path, "removed", n, "") for n in old if n not in new]
            out += [(place, path, "added", n, new[n].simpleString()) for n in new if n not in old]
            out += [(place, path, "retyped", n, f"{old[n].simpleString()} -> {new[n].simpleString()}") for n in new if n in old and old[n] != new[n]]
        yield pd.DataFrame(out, columns=["place", "path", "kind", "field", "detail"])


def scan_drifting_parquet(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one table of the union schema, changes: place, path, kind, field, detail).

    ``paths`` are in order of age. A field that a file lacks is NULL, also inside structs;
    values are cast to the joined type by name. Unreadable files are reported as
    ``unreadable`` and left out. Footers are read and folded by the executors: the driver
    gets the distinct schemas, and the number of its schema for each listed file. Files
    that read as the union schema are one scan; each other distinct schema is one more.
    """
    feet = written(parquet_footers(spark, paths), "footers")
    ok = feet.where("schema is not null")
    kinds = [r["schema"] for r in ok.groupBy("schema").agg(F.min("place").alias("first")).orderBy("first").collect()]
    rank = global_rank(ok.select("place", "path", "schema"), "place")
    before = rank.select((F.col("rank_no") + 1).alias("rank_no"), F.col("schema").alias("before"))
    pairs = rank.join(before, "rank_no").where("schema <> before").select("place", "path", "before", "schema", F.lit(None).cast("string").alias("problem"))
    torn = feet.where("schema is null").select("place", "path", F.lit(None).cast("string").alias("before"), "schema", "problem")
    log = pairs.unionByName(torn).mapInPandas(_differences, "place bigint, path string, kind string, field string, detail string")
    if not kinds:
        return spark.createDataFrame([], T.StructType([])), log
    schemas = [T.StructType.fromJson(json.loads(k)) for k in kinds]
    union = reduce(join_schemas, schemas)
    numbers = spark.createDataFrame(list(enumerate(kinds)), "kind int, schema string")
    groups: dict[int, list[str]] = {}
    for place, kind in ok.join(numbers, "schema").select("place", "kind").orderBy("place").collect():
        groups.setdefault(-1 if _reads_as(schemas[kind], union) else kind, []).append(paths[place])
    parts = [spark.read.schema(union).parquet(*groups.pop(-1))] if -1 in groups else []
    for kind, files in groups.items():
        have = {f.name: f.dataType for f in schemas[kind]}
        df = spark.read.schema(schemas[kind]).parquet(*files)
        parts.append(df.select(*((cast_to(F.col(f"`{u.name}`"), have[u.name], u.dataType) if u.name in have else F.lit(None).cast(u.dataType)).alias(u.name) for u in union)))
    return reduce(DataFrame.unionByName, parts), log
