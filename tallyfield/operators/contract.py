"""The play contract as queries: every rule yields the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.ingest import drive_window

KEY = ["drive_id", "play_id"]


def _rows(df: DataFrame, rule: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col("drive_id").alias("drive_id"), F.col("play_id").cast("long").alias("play_id"))


def violations(states: DataFrame, players: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """(rule, drive_id, play_id) of every violation; drive rules have a null play.

    ``states``: plays with next states. ``players``: universe with player_id.
    """
    nxt = [F.col(f"n_{c}").eqNullSafe(F.lead(c).over(drive_window())) for c in ("down", "ydstogo", "yardline_100")]
    whole = Window.partitionBy("drive_id")
    checked = states.select(
        *KEY, "down", "ydstogo", "yardline_100", "off_team", "def_team", "off_players", "def_players", "terminal",
        reduce(lambda a, b: a & b, nxt).alias("_next_ok"), F.lead("play_id").over(drive_window()).isNull().alias("_last"),
        F.count("*").over(Window.partitionBy(*KEY)).alias("_same"), F.sum(F.col("terminal").cast("int")).over(whole).alias("_ends"),
        F.min("drive_points").over(whole).alias("_least"), F.max("drive_points").over(whole).alias("_most"),
        F.min(F.struct("off_team", "def_team")).over(whole).alias("_t0"), F.max(F.struct("off_team", "def_team")).over(whole).alias("_t1"),
    )
    play_rules = {
        "r1_next_state": ~F.col("_next_ok"),
        "r2_terminal_last": F.col("terminal") != F.col("_last"),
        "r5_domain": ~(F.col("down").between(1, 4) & (F.col("ydstogo") >= 1) & (F.col("yardline_100") >= 1)),
        "r7_duplicate_key": F.col("_same") > 1,
        "d1_yardline": (F.col("yardline_100") > 99) | (F.col("ydstogo") > F.col("yardline_100")),
        "d2_duplicate_id": (F.size(F.array_distinct("off_players")) < F.size("off_players")) | (F.size(F.array_distinct("def_players")) < F.size("def_players")),
    }
    marks = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in play_rules.items())))
    by_play = checked.select(F.explode(marks).alias("rule"), *KEY)
    drive_rules = {"r2_one_terminal": F.col("_ends") != 1, "r3_drive_points": F.col("_least") != F.col("_most"), "r4_possession": (F.col("_t0") != F.col("_t1")) | (F.col("_t0.off_team") == F.col("_t0.def_team"))}
    marks = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in drive_rules.items())))
    by_drive = checked.select(F.explode(marks).alias("rule"), "drive_id", F.lit(None).cast("long").alias("play_id")).distinct()
    who = states.select(*KEY, F.explode(F.array_union("off_players", "def_players")).alias("player_id"))
    unknown = _rows(who.join(players, "player_id", "left_anti").select(*KEY).distinct(), "r6_unknown_player")
    out = by_play.union(by_drive).union(unknown)
    if teams is not None:
        t = states.select(*KEY, F.explode(F.array("off_team", "def_team")).alias("team"))
        out = out.union(_rows(t.join(teams, "team", "left_anti").select(*KEY).distinct(), "r6_unknown_team"))
    return out


def drive_islands(plays: DataFrame, order: str, by: list | None = None) -> DataFrame:
    """Runs of equal drive ids in file order, as first and last row and length. ``by``: columns
    that give the order of ``order`` where that was numbered by them, so that plays are sorted once."""
    w = Window.partitionBy("game_id").orderBy(*(by or [order]))
    new = F.when(F.lag("drive_id").over(w).eqNullSafe(F.col("drive_id")), 0).otherwise(1)
    marked = plays.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("game_id", "island", "drive_id").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
