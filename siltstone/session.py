"""Session settings and the shared folder for lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", app: str = "siltstone", **conf: str) -> SparkSession:
    """A local session with the engine's settings; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (CONF | {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_siltstone_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siltstone-code-")  # the driver serves the file from there while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/siltstone_code", "zip", os.path.dirname(root), os.path.basename(root)))
    context._siltstone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one is made only where none is set on one machine, as in tests.

    On a cluster each executor would write to a disk of its own and reading back would silently miss rows, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/siltstone-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has cut; results that were not written elsewhere can no longer be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*columns) if columns else out


@contextmanager
def plain(spark: SparkSession) -> Iterator[None]:
    """What runs within is not compiled stage by stage: the driver compiles each stage and keeps its classes, which many plans of
    few rows do not repay."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over at least as many partitions as there are cores, for stages that cost CPU per row.

    A table of many splits stays as it is: only a small one (few files) is moved, once.
    """
    spark = df.sparkSession
    want = max(spark.sparkContext.defaultParallelism, 2)
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *[F.col(k) for k in keys]) if keys else df.repartition(want)
