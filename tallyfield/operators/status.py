"""Read models over the store's runs, links and models: freshness, status, queues, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freshness(runs: DataFrame, thresholds: DataFrame, now: str) -> DataFrame:
    """Per source of ``thresholds`` (source, minutes): when it was last published, its age in
    seconds, and Fresh, Stale or Missing."""
    last = runs.where("state = 'done'").groupBy("source").agg(F.max("finished_at").alias("published"))
    j = F.broadcast(thresholds).join(last, "source", "left")
    age = F.lit(now).cast("timestamp_ntz").cast("timestamp").cast("long") - F.col("published").cast("timestamp").cast("long")
    j = j.withColumn("age_seconds", age)
    state = F.when(F.col("published").isNull(), "Missing").when(F.col("age_seconds") > F.col("minutes") * 60, "Stale").otherwise("Fresh")
    return j.select("source", "published", F.coalesce("age_seconds", F.lit(-1)).alias("age_seconds"), state.alias("state"))


def last_runs(runs: DataFrame) -> DataFrame:
    """The last run of each source that has come to an end, with how it ended, and how many failed."""
    ended = runs.where("state in ('done', 'failed')")
    last = F.max_by(F.struct("run_id", "state", "finished_at"), F.struct("finished_at", "run_id"))
    g = ended.groupBy("source").agg(last.alias("x"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed"))
    return g.select("source", "x.run_id", "x.state", "x.finished_at", "failed")


def running(runs: DataFrame) -> DataFrame:
    """Jobs that have not come to an end: how many of each source, since when, and the first."""
    return runs.where("state = 'running'").groupBy("source").agg(F.count("*").alias("n"), F.min("started_at").alias("since"), F.min_by("run_id", F.struct("started_at", "run_id")).alias("first_run"))


def review_queue(links: DataFrame, offset: int, size: int) -> DataFrame:
    """One page of the pending links: lower tiers first, the surest of a tier first."""
    return links.where("state = 'pending'").orderBy("tier", F.col("confidence").desc(), "provider_id").offset(offset).limit(size).select("tier", "provider_id", "player_id", "confidence")


def model_status(models: DataFrame) -> DataFrame:
    """Per family: versions, the one in production, the newest, and the last validation."""
    newest = F.max_by("version", F.struct("created", "version"))
    return models.groupBy("family").agg(
        F.count("*").alias("versions"),
        F.max(F.when(F.col("role") == "champion", F.col("version"))).alias("production"),
        newest.alias("newest"),
        F.max("validated").alias("last_validation"),
    )
