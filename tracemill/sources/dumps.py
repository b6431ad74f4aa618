"""Dumps of samples, verified copies and JSON sinks."""

from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_dump(df: DataFrame, template: str, rollout: int) -> str:
    """Samples of a rollout under a path template such as ``/dumps/{rollout}``; an existing dump is an error."""
    path = template.format(rollout=rollout)
    df.write.mode("errorifexists").parquet(path)
    return path


def load_dump(spark: SparkSession, template: str, rollout: int, order: str | None = None, keep: int | None = None) -> DataFrame:
    """A rollout's dump, or that of the template's fallback ``all``; ``keep`` takes half from its head and half from its tail by ``order``."""
    from tracemill.session import hadoop_path

    path = template.format(rollout=rollout)
    fs, p = hadoop_path(spark, path)
    df = spark.read.parquet(path if fs.exists(p) else template.format(rollout="all"))
    if keep is None:
        return df
    head = df.orderBy(order).limit(keep // 2)
    return head.unionByName(df.orderBy(F.desc(order)).limit(keep - keep // 2))


def write_gzip_json(df: DataFrame, path: str) -> None:
    """JSON lines, gzip; Hadoop's codec writes no time stamp, so equal parts have equal bytes."""
    df.write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def gzip_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, SHA-256 of each gzip file's content; a file is unpacked in its task, piece by piece."""

    def hashes(batches):
        import io

        import pandas as pd

        for b in batches:
            out = []
            for blob in b["content"]:
                h = hashlib.sha256()
                with gzip.GzipFile(fileobj=io.BytesIO(bytes(blob))) as f:
                    while piece := f.read(1 << 20):
                        h.update(piece)
                out.append(h.hexdigest())
            yield pd.DataFrame({"path": b["path"], "sha256": out})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(hashes, "path string, sha256 string")


def unpack_verified(source: str, target: str, expected: str) -> None:
    """One local gzip file unpacked; the target appears only if the content's SHA-256 is the expected one."""
    import os

    h, tmp = hashlib.sha256(), f"{target}.part"
    with gzip.open(source, "rb") as f, open(tmp, "wb") as out:
        while piece := f.read(1 << 20):
            h.update(piece)
            out.write(piece)
    if h.hexdigest() != expected:
        os.remove(tmp)
        raise ValueError(f"{source}: content is {h.hexdigest()}, not {expected}")
    os.replace(tmp, target)
