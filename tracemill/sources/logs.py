"""Line logs, JSON arrays, metric logs and guarded sinks.

Line numbers come from a single read of a file's text with its row index, so "the last
line wins" has a real order; files are split by Spark where no order is asked.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.nested import strict_json
from tracemill.session import hadoop_path


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or JSON lines as VARIANT ``record``; other suffixes raise ValueError.

    An optional slice ``path@[a:b]`` counts rows in the order of files and of rows in them;
    negative bounds count from the end.
    """
    m = re.fullmatch(r"(.*)@\[(-?\d*):(-?\d*)\]", path)
    path = m[1] if m else path
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    elif path.endswith((".jsonl", ".jsonl.gz")):
        df = json_lines(spark, path)
        place = [F.col("path").alias("_file"), F.col("line_no").alias("_row")]
    else:
        raise ValueError(f"neither .parquet nor .jsonl: {path}")
    columns = df.columns if path.endswith(".parquet") else ["record"]
    if not m:
        return df.select(*columns)
    a, b = (int(x) if x else None for x in m.groups()[1:])
    n = df.count() if (a or 0) < 0 or (b or 0) < 0 else 0
    a, b = max(0, n + a if (a or 0) < 0 else a or 0), n + b if b is not None and b < 0 else b
    rows = df.select(*columns, *place).orderBy("_file", "_row").offset(a)
    return (rows if b is None else rows.limit(max(0, b - a))).select(*columns)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1), line. Each file is read whole, as line numbers need it; the files are read in parallel."""
    text = spark.read.text(path.split(","), wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\n").alias("l"))
    return text.select("path", F.posexplode("l").alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def json_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """path, line_no, record (VARIANT). Blank lines are skipped; bad ones too, or raise with their number."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "").withColumn("record", strict_json(F.col("line")))
    if strict:
        bad = F.raise_error(F.concat(F.lit("bad line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("path")))
        return rows.select("path", "line_no", F.coalesce("record", bad.cast("variant")).alias("record"))
    return rows.where("record is not null").select("path", "line_no", "record")


def latest_lines(lines: DataFrame, key_path: str) -> DataFrame:
    """key, record of its last line, attempts."""
    k = F.try_variant_get("record", key_path, "string")
    rows = lines.select(k.alias("key"), "path", "line_no", F.to_json("record").alias("j")).where("key is not null")
    best = rows.groupBy("key").agg(F.max_by("j", F.struct("path", "line_no")).alias("j"), F.count("*").alias("attempts"))
    return best.select("key", F.parse_json("j").alias("record"), "attempts")


def append_records(df: DataFrame, path: str) -> int:
    """Appends rows as one batch of JSON lines under ``path``; the batch's number. A batch that fails leaves nothing that is read."""
    from tracemill.sources.manifest import Manifest

    m = Manifest(df.sparkSession, path)
    n = (m.read() or {"batches": 0})["batches"]
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/batch={n:08d}")
    m.commit({"batches": n + 1})
    return n


def appended_records(spark: SparkSession, path: str, key_path: str) -> DataFrame:
    """key, record, attempts over all appended batches: a later batch wins, then the later line."""
    from tracemill.sources.manifest import Manifest

    n = (Manifest(spark, path).read() or {"batches": 0})["batches"]
    return latest_lines(json_lines(spark, ",".join(f"{path}/batch={i:08d}" for i in range(n))), key_path)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file with one top-level array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def metric_log(lines: DataFrame, column: str, pattern: str = r"perf (\d+): (\{.*\})") -> DataFrame:
    """step, metric, value of lines such as ``perf 12: {'a': 1.5}``; only finite numbers are kept."""

    @F.pandas_udf("map<string,double>")
    def numbers(s):
        out = []
        for x in s:
            try:
                d = ast.literal_eval(x)
            except (ValueError, SyntaxError, TypeError):
                d = {}
            out.append({k: float(v) for k, v in d.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < float("inf")} if isinstance(d, dict) else {})
        return __import__("pandas").Series(out, dtype=object)

    hit = lines.where(F.col(column).rlike(pattern))
    rows = hit.select(F.regexp_extract(column, pattern, 1).cast("bigint").alias("step"), F.regexp_extract(column, pattern, 2).alias("d"))
    return rows.select("step", F.explode(numbers("d")).alias("metric", "value"))


def typed_csv(spark: SparkSession, path: str, text_columns: set[str]) -> DataFrame:
    """A headed CSV in which all columns but the named ones are numbers; empty is NULL."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*(F.col(c) if c in text_columns else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in df.columns))


def glob_records(spark: SparkSession, pattern: str, group: str) -> DataFrame:
    """group, record of every JSON file matched by a glob; ``group`` is a regex whose first group is taken from the path."""
    text = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    return text.select(F.regexp_extract("p", group, 1).alias("group"), strict_json(F.col("value")).alias("record"))


def prompt_rows(tasks: DataFrame, *columns: str) -> DataFrame:
    """line (JSON) and its SHA-256."""
    line = F.to_json(F.struct(*columns))
    return tasks.select(line.alias("line"), F.sha2(line, 256).alias("sha256"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of files; and of the text with CRLF as LF."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha2(F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n")), 256).alias("text_sha256"))


def write_new(df: DataFrame, path: str, sources: list[str] = ()) -> None:
    """Writes Parquet to a path that must neither exist nor be one of its sources."""
    if path.rstrip("/") in {s.rstrip("/") for s in sources}:
        raise ValueError("the target is a source")
    df.write.mode("errorifexists").parquet(path)


def replace_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON file, replaced in one rename."""
    from tracemill.sources.manifest import Manifest

    folder, _, name = path.rpartition("/")
    Manifest(spark, folder, name).commit(value)


def point_lookup(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of a few keys; the filter reaches the scan."""
    return df.where(F.col(key).isin(values))


