"""Queries that run a stream to its end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tallyfield import views as v
from tallyfield.plans.models import _FILTER, series
from tallyfield.registry import query
from tallyfield.session import removed, scratch, written
from tallyfield.streaming.corrections import filtered_stream, last_word, run_to_end
from tallyfield.streaming.stateful import talent_updates
from tallyfield.streaming.weekly import windowed_counts


def checkpoint_root(spark) -> str:
    """The shared folder; a local session may use one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp()


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY ALL")
def st_windowed_counts(spark, d):
    """Tumbling weeks over the event stream, run to the end of the input."""
    schema = v.read(spark, d, "events").schema
    s = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"weeks_{uuid.uuid4().hex[:8]}"
    at = checkpoint_root(spark)
    q = windowed_counts(s).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{at}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("long").alias("total"))




@query("SELECT 'u' || user_id AS player_id, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total, max(event_id) AS last_event, round(1 / (1 + count(*) / 0.5::DOUBLE), 8) AS var, round(sum(value) / 20 / (count(*) + 0.5::DOUBLE), 6) AS talent FROM events GROUP BY user_id")
def st_player_talent(spark, d):
    """Each player's state at the end of the stream; of constant noise the filter is a shrunk mean."""
    schema = v.read(spark, d, "events").schema
    s = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d)
    s = s.select(F.concat(F.lit("u"), "user_id").alias("player_id"), "event_id", "value")
    name = f"talent_{uuid.uuid4().hex[:8]}"
    q = talent_updates(s).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{checkpoint_root(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table(name).groupBy("player_id").agg(F.max_by(F.struct("n", "total", "last_event", "var", "talent"), "n").alias("x"))
    return last.select("player_id", "x.n", "x.total", "x.last_event", F.round("x.var", 8).alias("var"), F.round("x.talent", 6).alias("talent"))


_NO_LOOK = _FILTER.replace("coalesce(avg(y) FILTER (k <= 3), 0)::DOUBLE AS x0", "0.0::DOUBLE AS x0")


@query("WITH RECURSIVE " + v.with_("history", "SELECT r.player_id, o.season, o.week, round(x0, 6) AS talent, round(x0 + x1 + x2, 6) AS total, round(var, 7) AS var FROM run r JOIN par o USING (player_id, k)", _NO_LOOK)[5:])
def st_corrected_filter(spark, d):
    """Weeks that arrive latest first, some wrong before they are corrected: the last word on each
    week is the batch filter's."""
    s = series(spark, d).withColumn("snaps", F.col("snaps").cast("double"))
    weeks = s.select("player_id", "position", "season", "week", "y", "snaps", "event", F.lit(2).cast("long").alias("revision"))
    weeks, weeks_at = written(weeks)  # read five times
    wrong = weeks.where("week % 3 = 0").withColumns({"y": F.lit(5.0), "revision": F.lit(1).cast("long")})
    at = scratch(spark)
    for order, part in enumerate((weeks.where("season = 2024"), wrong, weeks.where("season < 2024 and week > 5"), weeks.where("season < 2024 and week <= 5"))):
        part.write.parquet(f"{at}/in/part={order}")
    removed(spark, weeks_at)
    files = len(spark.read.schema(weeks.schema).option("recursiveFileLookup", True).parquet(f"{at}/in").inputFiles())
    at_once = max(8, -(-files // 4))  # some four batches, however many files there are
    stream = spark.readStream.schema(weeks.schema).option("maxFilesPerTrigger", at_once).option("recursiveFileLookup", True).parquet(f"{at}/in")
    told = last_word(run_to_end(filtered_stream(stream), f"{at}/out", f"{at}/checkpoint"))
    return told.select("player_id", "season", "week", F.round("x0", 6).alias("talent"), F.round(F.col("x0") + F.col("x1") + F.col("x2"), 6).alias("total"), F.round("var", 7).alias("var"))
