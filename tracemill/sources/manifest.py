"""A store's committed state: one small JSON file, replaced in a single rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tracemill.session import hadoop_path


class Manifest:
    """``<path>/<name>``; readers see the old or the new state, never a mixture."""

    def __init__(self, spark: SparkSession, path: str, name: str = "CURRENT"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def read(self) -> dict | None:
        fs, p = hadoop_path(self.spark, f"{self.path}/{self.name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, state: dict) -> None:
        fs, tmp = hadoop_path(self.spark, f"{self.path}/{self.name}.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, final = hadoop_path(self.spark, f"{self.path}/{self.name}")
        context = self.spark.sparkContext
        rename = context._jvm.org.apache.hadoop.fs.Options.Rename
        option = context._gateway.new_array(rename, 1)
        option[0] = rename.OVERWRITE
        context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), context._jsc.hadoopConfiguration()).rename(tmp, final, option)
