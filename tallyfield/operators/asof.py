"""Information as of a point in time: predicates, slices, guards and naive baselines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LeakageError(ValueError):
    """A frame shows what was not yet known."""


@dataclass(frozen=True)
class AsOf:
    """Before the games of (season, week): outcomes to the week before, pre-game facts to the week."""

    season: int
    week: int

    def __post_init__(self):
        if self.week < 1:
            raise ValueError("weeks count from 1")

    def keep(self, cutoff: int) -> Column:
        """Slots up to ``cutoff`` of the season; plain comparisons, so scans can use them."""
        return (F.col("season") < self.season) | ((F.col("season") == self.season) & (F.col("week") <= cutoff))

    @property
    def outcome(self) -> Column:
        return self.keep(self.week - 1)

    @property
    def pregame(self) -> Column:
        return self.keep(self.week)

    def published(self, lock: Column) -> Column:
        """The slot is known and it was published before the lock."""
        return self.outcome & (F.col("published_at") < lock)

    def slice_plays(self, plays: DataFrame) -> DataFrame:
        self._needs(plays, "season", "week")
        return plays.where(self.outcome)

    def slice_interventions(self, events: DataFrame) -> DataFrame:
        self._needs(events, "season", "week")
        return events.where(self.pregame)

    def slice_pool(self, plays: DataFrame) -> DataFrame:
        """Everyone who took part before this point."""
        return self.slice_plays(plays).select(F.explode(F.array_union("off_players", "def_players")).alias("player_id")).distinct()

    def leaked(self, df: DataFrame) -> DataFrame:
        """Rows that an outcome frame must not have."""
        return df.where(~self.outcome)

    def assert_clean(self, df: DataFrame) -> DataFrame:
        if not self.leaked(df).isEmpty():
            raise LeakageError(f"rows at or after season {self.season} week {self.week}")
        return df

    @staticmethod
    def _needs(df: DataFrame, *columns: str) -> None:
        if missing := set(columns) - set(df.columns):
            raise LeakageError(f"undated frame: {sorted(missing)}")


def watermark(df: DataFrame) -> DataFrame:
    """The last (season, week) of a frame."""
    m = F.max(F.struct("season", "week"))
    return df.agg(m.alias("m")).select("m.season", "m.week")


def persistence(history: DataFrame, at: AsOf) -> DataFrame:
    """Points of the most recent week of this season."""
    h = history.where((F.col("season") == at.season) & (F.col("week") < at.week))
    weekly = h.groupBy("player_id", "week").agg(F.avg("points").alias("p"))
    return weekly.groupBy("player_id").agg(F.max_by("p", "week").alias("forecast"))


def season_to_date(history: DataFrame, at: AsOf) -> DataFrame:
    """Mean and spread of this season so far; a missing or zero spread becomes the spread of
    the means."""
    h = history.where((F.col("season") == at.season) & (F.col("week") < at.week))
    m = h.groupBy("player_id").agg(F.avg("points").alias("forecast"), F.stddev_samp("points").alias("_sd"))
    pooled = m.agg(F.stddev_samp("forecast").alias("_p")).select(F.when(F.col("_p") > 0, F.col("_p")).otherwise(1e-6).alias("_pooled"))
    m = m.join(F.broadcast(pooled), F.lit(True))  # one row
    return m.select("player_id", "forecast", F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.col("_pooled")).alias("sd"))


def last_season(history: DataFrame, at: AsOf) -> DataFrame:
    return history.where(F.col("season") == at.season - 1).groupBy("player_id").agg(F.avg("points").alias("forecast"))


def rolling_mean(history: DataFrame, games: int = 3) -> DataFrame:
    """Mean of the last ``games`` active weeks before each row."""
    w = Window.partitionBy("player_id").orderBy("season", "week").rowsBetween(-games, -1)
    return history.withColumn("rolling", F.avg("points").over(w))


def recency_mean(history: DataFrame, at: AsOf, rho: float = 0.9, weeks: int = 18) -> DataFrame:
    """Mean weighted by rho to the age in weeks."""
    age = (F.lit(at.season) - F.col("season")) * weeks + F.lit(at.week) - F.col("week")
    weight = F.pow(F.lit(rho), age)
    return history.where(at.outcome).groupBy("player_id").agg((F.sum(weight * F.col("points")) / F.sum(weight)).alias("forecast"))


def densify(history: DataFrame) -> DataFrame:
    """Every player in every slot anyone played; points and ``played`` where missing are null
    and false. Slots are a calendar: they go to each player as an array, not as a join."""
    slots = history.select("season", "week").distinct().agg(F.sort_array(F.collect_set(F.struct("season", "week"))).alias("slots"))
    players = history.select("player_id").distinct()
    grid = players.join(F.broadcast(slots), F.lit(True)).select("player_id", F.explode("slots").alias("s")).select("player_id", "s.season", "s.week")
    seen = history.groupBy("player_id", "season", "week").agg(F.sum("points").alias("points"))
    return grid.join(seen, ["player_id", "season", "week"], "left").withColumn("played", F.col("points").isNotNull())


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key; within ``new`` the
    last by ``order`` wins."""
    if order is not None:
        last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))
