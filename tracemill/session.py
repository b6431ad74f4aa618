"""Session helpers: local sessions for tests, shared work folders for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A UTC session on local threads with AQE; for tests, benches and examples."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracemill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor shares (``spark.checkpoint.dir``).

    Only a local master, as in tests, may name none and gets one of its own; on a
    cluster a folder of one machine would lose rows, so that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        context.setCheckpointDir(root)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written columnar table: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that are deleted together when the ``with`` block ends.

    A result that outlives the block must be written outside it (``written``).
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def path(self, name: str) -> str:
        self.paths.append(work_path(self.spark, name))
        return self.paths[-1]

    def written(self, df: DataFrame, name: str, part: str | None = None, block: int | None = None) -> DataFrame:
        """As ``written``; with ``part`` a folder for each of its values, with ``block`` row groups of about so many bytes."""
        path, out = self.path(name), df.write
        if block:
            out = out.option("parquet.block.size", block)
        (out.partitionBy(part) if part else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        while self.paths:
            path = self.paths.pop()
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed into the shared folder (for small iterated state)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of ``path`` through the JVM's file-system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in the executors' Python workers; once per application.

    Spark itself distributes the archive, so it does not matter how the driver found
    the package.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tracemill-"), "tracemill.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
