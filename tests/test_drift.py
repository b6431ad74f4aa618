"""Drifting schemas: JSON fields against a brute-force reading, and Parquet files."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracemill.operators import drift as d

KIND = {str: "string", int: "number", float: "number", bool: "boolean", list: "array", dict: "object"}


def brute(rows):
    files, fields, entries = {}, {}, {}
    for no, s, q, e, text in sorted(rows, key=lambda r: r[0]):
        files.setdefault(s, set()).add(q)
        try:
            o = json.loads(text)
        except (TypeError, ValueError):
            continue
        if not isinstance(o, dict):
            continue
        if e is not None:
            entries.setdefault((s, q), {})[e] = o
        for k, v in o.items():
            fields.setdefault((s, q), {}).setdefault(k, set()).update({KIND[type(v)]} if v is not None else ())
    out = set()
    for s, qs in files.items():
        last, prev = {}, None
        for q in sorted(qs):
            now = fields.get((s, q), {})
            if prev is not None:
                was = fields.get((s, prev), {})
                gone, came = set(was) - set(now), set(now) - set(was)
                ren = set()
                a, b = entries.get((s, prev), {}), entries.get((s, q), {})
                for g in gone:
                    both = [e for e in a if e in b and a[e].get(g) is not None]
                    for c in came:
                        if len(both) >= 3 and sum(c in b[e] and b[e][c] is not None and json.dumps(a[e][g], sort_keys=True) == json.dumps(b[e][c], sort_keys=True) for e in both) * 4 >= 3 * len(both):
                            ren.add((g, c))
                out |= {(s, q, "renamed", g, c) for g, c in ren}
                out |= {(s, q, "removed", g, "") for g in gone - {x for x, _ in ren}} | {(s, q, "added", "", c) for c in came - {x for _, x in ren}}
                for f in set(now) & set(was):
                    if now[f] and last.get(f) and now[f] != last[f]:
                        out.add((s, q, "retyped", f, f))
                for g in gone:
                    last.pop(g, None)
            for f, t in now.items():
                if t:
                    last[f] = t
            prev = q
    return out


def test_changes_equal_brute_force(spark):
    rnd, rows, no = random.Random(5), [], 0
    for s in ("r1", "r2", None):
        for q in (0, 1, 3, 4, 6):
            for e in ["a", "b", "c", "d", "e", None]:
                no += 1
                o = {"t" if q < 3 else "title": f"x{e}", "n": rnd.choice([1, "1", None]) if q > 1 else 1, "z": {"k": [1, 2]}}
                if rnd.random() < 0.3:
                    o["extra"] = rnd.choice([True, 0.5, None])
                text = rnd.choice([json.dumps(o)] * 8 + [None, json.dumps(o)[:-2], "[1]"])
                rows.append((no, s, q, e, text))
                if rnd.random() < 0.2:
                    no += 1
                    rows.append((no, s, q, e, text))
    df = spark.createDataFrame(rows, "no bigint, s string, q int, e string, record string")
    got = {tuple(r) for r in d.field_cells(df, "s", "q", F.col("e"), "no", "record").changes().collect()}
    assert got == brute([r for r in rows if r[1] is not None])


def test_empty_and_uniform(spark):
    df = spark.createDataFrame([(1, "s", 0, "e", '{"a": 1, "b": "x"}', 9), (2, "s", 1, "e", '{"a": "y", "b": null}', 9), (3, "s", 1, "f", "torn{", 9)], "no bigint, s string, q int, e string, record string, field int")
    log = d.field_cells(df, "s", "q", F.col("e"), "no", "record")
    assert {tuple(r) for r in log.union_types().collect()} == {("a", "string"), ("b", "string")}
    rows = d.uniform_table(df, "record", {"a": "string", "b": "string"}).orderBy("no").collect()
    assert [(r.record_a, r.record_b) for r in rows] == [("1", "x"), ("y", None), (None, None)]
    assert d.field_cells(df.limit(0), "s", "q", F.col("e"), "no", "record").changes().count() == 0


def test_parquet_files(spark, tmp_path):
    a, b, c = (str(tmp_path / f"{n}.parquet") for n in "abc")
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int32()), "v": ["x", "y"], "old": [1.5, 2.5]}), a)
    pq.write_table(pa.table({"id": pa.array([3], pa.int64()), "v": pa.array([7], pa.int64()), "new": [True]}), b)
    (tmp_path / "c.parquet").write_bytes(b"no parquet")
    df, log = d.scan_drifting_parquet(spark, [a, b, c])
    assert df.schema.simpleString() == "struct<id:bigint,v:string,old:double,new:boolean>"
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == [(1, "x", 1.5, None), (2, "y", 2.5, None), (3, "7", None, True)]
    assert [(r.kind, r.field) for r in log.orderBy("place", F.expr("array_position(array('removed', 'added', 'retyped'), kind)"), "field").collect()] == [("removed", "old"), ("added", "new"), ("retyped", "id"), ("retyped", "v"), ("unreadable", "")]


def test_lattice():
    from pyspark.sql import types as T

    assert d.join_types(T.LongType(), T.FloatType()) == d.join_types(T.LongType(), T.DoubleType()) == T.StringType()
    assert d.join_types(T.IntegerType(), T.FloatType()) == T.DoubleType() and d.join_types(T.ShortType(), T.FloatType()) == T.FloatType()
    assert d.join_types(T.DecimalType(10, 2), T.LongType()) == T.DecimalType(22, 2) and d.join_types(T.DecimalType(10, 2), T.DecimalType(9, 4)) == T.DecimalType(12, 4)
    assert d.join_types(T.DecimalType(38, 2), T.DecimalType(38, 10)) == T.StringType() == d.join_types(T.DecimalType(5, 1), T.DoubleType())
    assert d.join_types(T.MapType(T.StringType(), T.IntegerType()), T.MapType(T.StringType(), T.LongType())) == T.MapType(T.StringType(), T.LongType())
    assert d.join_types(T.NullType(), T.DateType()) == T.DateType()
    assert d.join_types(T.BooleanType(), T.LongType()) == T.StringType()
    for x in (T.LongType(), T.StringType(), T.ArrayType(T.IntegerType())):
        assert d.join_types(x, x) == x


def test_nested_growth_and_exact_numbers(spark):
    """A struct that gains a member, an array of such, and a long beside a double lose nothing."""
    from tracemill.session import work_path

    paths = []
    for sql in (
        "select 1 as i, named_struct('a', 1) as s, array(named_struct('x', 1)) as l, 9007199254740993 as n, cast(1.5 as decimal(5,1)) as d, map('k', 1) as m",
        "select 2 as i, named_struct('b', 'q', 'a', 2L) as s, array(named_struct('y', 'z', 'x', 2)) as l, 0.5D as n, cast(2.25 as decimal(9,4)) as d, map('k', 2L) as m",
        "select 3 as i, cast(null as struct<a:int>) as s, cast(null as array<struct<x:int>>) as l, cast(null as bigint) as n, cast(null as decimal(5,1)) as d, cast(null as map<string,int>) as m",
    ):
        path = work_path(spark, "nest")
        spark.sql(sql).coalesce(1).write.parquet(path)
        paths += spark.read.parquet(path).inputFiles()
    df, log = d.scan_drifting_parquet(spark, paths)
    got = {r.i: r for r in df.collect()}
    assert (got[1].s.a, got[1].s.b, got[2].s.a, got[2].s.b, got[3].s) == (1, None, 2, "q", None)
    assert got[1].l[0].asDict() == {"x": 1, "y": None} and got[2].l[0].asDict() == {"x": 2, "y": "z"} and got[3].l is None
    assert got[1].n == "9007199254740993" and got[2].n == "0.5" and str(got[1].d) == "1.5000" and str(got[2].d) == "2.2500" and got[2].m == {"k": 2}
    assert log.where("kind = 'retyped'").count() == 10
