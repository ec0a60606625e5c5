"""Streaming: box-score events into windows, and weekly Gram blocks that are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import attribution


def event_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Events of a folder as they arrive; the time is cast, as watermarks need a timestamp."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events and value per type and tumbling window; the same expression serves a batch."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def blocks_writer(players: DataFrame, block_dir: str):
    """For ``foreachBatch``: a batch of valued plays replaces the blocks of its weeks.

    A batch must hold whole weeks; a batch that runs again, or a corrected week, overwrites
    its own partitions, so the sum over blocks is right in either case.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            attribution.weekly_update(batch.sparkSession, batch, players, block_dir)

    return write
