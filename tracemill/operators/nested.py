"""Deeply nested, loosely typed records to related flat tables.

A record is a JSON text (or a native array). A list inside it is addressed by
one JSON path per nesting level; every emitted row keeps the record's key and
the element's zero-based place on each level, so parent and child tables join
on (key, places).

The plan is a higher-order projection: one strict parse per record, nested
``transform`` calls that attach the ancestors' places, ``flatten`` to join the
lists, and one ``inline`` per target table. There is no shuffle.

Defined results: a null record and one that is not a single valid JSON value
have no elements; a missing or null list has none; null elements keep their
place but are not emitted; a string holding a JSON array counts as that array;
any other single value is a list of one. Repeated rows emit repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wildcard level: the record is an object whose members each hold the list.
EACH_KEY = "*"


@dataclass(frozen=True)
class ListSpec:
    """A list inside a record.

    ``name`` is written to ``array_path``. ``levels`` has a JSON path for each
    nesting level, at most two. With ``each_key`` the record's members are
    visited and the path is applied to each; ``name`` then holds a ``{}`` for
    the member's name.
    """

    name: str
    levels: tuple[str, ...]
    each_key: bool = False


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    The parser stops after the first value; wrapping the text into an array
    makes trailing matter an error or a second element.
    """
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(whole) == 1, F.element_at(whole, 1))


def absent(v: Column) -> Column:
    """SQL NULL or JSON null."""
    return v.isNull() | F.is_variant_null(v)


def as_list(v: Column) -> Column:
    """array<variant> of a loosely typed value (see the module's rules)."""
    text = F.try_variant_get(v, "$", "string")
    inner = F.try_variant_get(strict_json(text), "$", "array<variant>")
    return F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        F.when(F.ltrim(text).startswith("["), inner),
        F.when(~absent(v), F.array(v)),
    )


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _rows(lst: Column, name: Column, deeper: str | None) -> Column:
    """array<struct> of one list, or of the lists below its elements."""
    if deeper is None:
        return F.transform(
            lst,
            lambda x, i: F.struct(name.alias("array_path"), i.cast("int").alias("pos1"), F.lit(-1).alias("pos2"), x.alias("element")),
        )
    return F.flatten(
        F.transform(
            F.coalesce(lst, F.array().cast("array<variant>")),
            lambda x, i: F.coalesce(
                F.transform(
                    as_list(at(x, deeper)),
                    lambda y, j: F.struct(name.alias("array_path"), i.cast("int").alias("pos1"), j.cast("int").alias("pos2"), y.alias("element")),
                ),
                F.array().cast("array<struct<array_path:string,pos1:int,pos2:int,element:variant>>"),
            ),
        )
    )


def _spec_rows(record: Column, spec: ListSpec) -> Column:
    none = F.array().cast("array<struct<array_path:string,pos1:int,pos2:int,element:variant>>")
    deeper = spec.levels[1] if len(spec.levels) > 1 else None
    if not spec.each_key:
        return F.coalesce(_rows(as_list(at(record, spec.levels[0])), F.lit(spec.name), deeper), none)
    head, _, tail = spec.name.partition("{}")
    members = F.map_entries(F.try_variant_get(record, "$", "map<string,variant>"))
    per_key = F.transform(
        members,
        lambda m: F.coalesce(
            _rows(as_list(at(m["value"], spec.levels[0])), F.concat(F.lit(head), m["key"], F.lit(tail)), deeper), none
        ),
    )
    return F.coalesce(F.flatten(per_key), none)


def list_elements(df: DataFrame, key: str, record: str, specs: list[ListSpec], keep_value: bool = True) -> DataFrame:
    """(key, array_path, pos1, pos2[, element]) of all lists, by one parse and one inline.

    ``element`` is a VARIANT. Other columns of ``df`` are not touched, so names
    that clash with the output do no harm.
    """
    parsed = df.select(F.col(key).alias("k"), strict_json(F.col(record)).alias("r")).where("r is not null")
    lists = [_spec_rows(F.col("r"), s) for s in specs]
    rows = F.filter(F.concat(*lists) if len(lists) > 1 else lists[0], lambda x: ~absent(x["element"]))
    if not keep_value:
        rows = F.transform(rows, lambda x: F.struct(x["array_path"].alias("array_path"), x["pos1"].alias("pos1"), x["pos2"].alias("pos2")))
    return parsed.select(F.col("k").alias(key), F.inline(rows))


def native_elements(df: DataFrame, key: str, column: str) -> DataFrame:
    """The same for a native array column: (key, array_path, pos1, pos2, element)."""
    rows = F.transform(
        F.col("a"),
        lambda x, i: F.struct(F.lit(column).alias("array_path"), i.cast("int").alias("pos1"), F.lit(-1).alias("pos2"), x.alias("element")),
    )
    rows = F.filter(rows, lambda x: x["element"].isNotNull())
    return df.select(F.col(key).alias("k"), F.col(column).alias("a")).select(F.col("k").alias(key), F.inline(rows))


def child_table(df: DataFrame, key: str, record: str, spec: ListSpec, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One flat child table: (key, pos1[, pos2], typed fields by JSON path).

    A member that can't be read as the asked type is NULL. Of an ``each_key``
    list, ``array_path`` tells the member.
    """
    rows = list_elements(df, key, record, [spec])
    keys = [key, *(["array_path"] if spec.each_key else []), "pos1", *(["pos2"] if len(spec.levels) > 1 else [])]
    return rows.select(*keys, *(F.try_variant_get("element", path, kind).alias(name) for name, (path, kind) in fields.items()))
