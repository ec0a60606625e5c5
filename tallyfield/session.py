"""Session defaults for local runs; a cluster's own settings are left alone."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, memory: str = "8g", **extra: str) -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("tallyfield")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in extra.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def package_on_workers(spark: SparkSession) -> None:
    """Put this package's folder on the path of Python workers on the driver's machine; a
    cluster ships the package (``--py-files``)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[1]))


def scratch(spark: SparkSession) -> str:
    """URI of a new folder that driver and executors share, under ``spark.checkpoint.dir``; a
    local session without that setting gets a temporary one, a cluster without it is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyfield.scratch.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyfield-")
        spark.conf.set("tallyfield.scratch.dir", at)
    at = f"{at.rstrip('/')}/tallyfield/{uuid.uuid4().hex[:16]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    hadoop = path.getFileSystem(spark._jsc.hadoopConfiguration())
    hadoop.mkdirs(path)
    hadoop.deleteOnExit(path)  # when the session's JVM ends, if not before
    return at


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where: its lineage ends there."""
    at = scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def removed(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Inside, Arrow batches to Python end by their number of rows alone, if that is limited. Spark
    also measures a batch's bytes after each row, which costs more than to write a row of few
    short values; for such rows only."""
    size, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) <= 0:
        yield
        return
    before = spark.conf.get(size, None)
    spark.conf.set(size, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.set(size, before) if before is not None else spark.conf.unset(size)
