"""Named parquet tables under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``<root>/<name>.parquet`` (a file or a folder of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
