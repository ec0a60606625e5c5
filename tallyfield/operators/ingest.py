"""From raw play-by-play to contract plays: filters, labels, next states, participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.schemas import STATS



def drive_window(drive: str = "drive_id"):
    """Plays of a drive in order."""
    return Window.partitionBy(drive).orderBy("play_id")


DRIVE_POINTS = {"Touchdown": 7, "Field goal": 3}
NO_POINTS = ["Punt", "Turnover", "Turnover on downs", "Missed field goal", "End of half", "Opp touchdown", "Safety"]


def modelled(raw: DataFrame) -> DataFrame:
    """Passes and runs with a down."""
    return raw.where(F.col("play_type").isin("pass", "run") & F.col("down").isNotNull())


def drive_points(result: Column, semantics: str = "oracle") -> Column:
    """Points of a drive by its result; ``corrected`` raises on a result it doesn't know."""
    points = F.when(result == "Touchdown", 7).when(result == "Field goal", 3)
    if semantics == "oracle":
        return points.otherwise(0)
    return points.when(result.isin(NO_POINTS), 0).otherwise(F.raise_error(F.concat(F.lit("unknown drive result: "), F.coalesce(result, F.lit("null")))).cast("int"))


def split_ids(ids: Column) -> Column:
    """A ';' list as an array without blanks; null gives an empty one."""
    parts = F.split(ids, ";")
    # else there is nothing to filter, which is slow
    odd = ids.contains(" ") | ids.contains(";;") | ids.startswith(";") | ids.endswith(";") | (ids == "")
    return F.coalesce(F.when(odd, F.filter(parts, lambda x: F.trim(x) != "")).otherwise(parts), F.array().cast("array<string>"))


def build_plays(raw: DataFrame, participation: DataFrame | None = None, semantics: str = "oracle", next_by: str | None = None) -> DataFrame:
    """Contract plays; participants from their own frame by (game_id, play_id) if given.
    ``next_by``: also the state after each play (``with_next_state``), drives told apart by that column."""
    p = modelled(raw)
    if participation is not None:
        part = participation.select("game_id", F.col("play_id").cast("long").alias("play_id"), "offense_players", "defense_players")
        p = p.drop("offense_players", "defense_players").withColumn("play_id", F.col("play_id").cast("long")).join(part, ["game_id", "play_id"], "left")
    p = p.withColumn("drive_points", drive_points(F.col("result"), semantics))
    if next_by:  # before ids are lists, which are slow to sort
        p = with_next_state(p, next_by)
    return p.select(
        "game_id", "drive_id", "play_id", "season", "week", "off_team", "def_team", "down", "ydstogo", "yardline_100", "yards", "play_type", "clock", "drive_points",
        split_ids(F.col("offense_players")).alias("off_players"), split_ids(F.col("defense_players")).alias("def_players"),
        *(NEXT if next_by else ()),
    )


NEXT = ["n_down", "n_ydstogo", "n_yardline_100", "terminal", "terminal_value"]


def with_next_state(plays: DataFrame, drive: str = "drive_id") -> DataFrame:
    """State after each play within its drive; null and ``terminal`` on the last one. ``drive``:
    the column that tells drives apart."""
    last = F.lead("play_id").over(drive_window(drive)).isNull()
    return plays.withColumns(
        {
            **{f"n_{c}": F.lead(c).over(drive_window(drive)) for c in ("down", "ydstogo", "yardline_100")},
            "terminal": last,
            "terminal_value": F.when(last, F.col("drive_points")),
        }
    )


SITUATIONS: dict[str, str] = {
    "red_zone": "yardline_100 <= 20",
    "passing_downs": "(down = 3 and ydstogo >= 7) or down = 4",
    "rushing_downs": "down <= 2 and ydstogo <= 4",
    "two_minute": "clock <= 120",
}


def situations(plays: DataFrame, names: dict[str, str] = SITUATIONS) -> DataFrame:
    """A row per play and situation it is in; ``two_minute`` only if there is a clock."""
    have = {n: c for n, c in names.items() if n != "two_minute" or "clock" in plays.columns}
    marks = F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in have.items()))
    return plays.withColumn("situation", F.explode(F.array_compact(marks)))


def season_stats(plays: DataFrame) -> DataFrame:
    """Snapshot manifest: rows, drives and share of rows with participants, per season."""
    return plays.groupBy("season").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("drive_id").alias("n_drives"),
        F.round(F.avg((F.size("off_players") > 0).cast("double")), 4).alias("participation"),
    )


def box_score(pbp: DataFrame) -> DataFrame:
    """Player-week statistics from normalised play-by-play: one union, one aggregation.

    Passer, rusher, receiver and fumbler of a play are exploded into rows that carry what
    they add, so no outer join of partial frames is needed.
    """
    td = lambda kind: F.when(F.col("td_type") == kind, 1).otherwise(0)
    roles = {
        "passer": (F.col("pass_attempt") == 1, "passer_id", {"pass_attempts": F.lit(1), "completions": F.col("complete_pass"), "passing_yards": F.col("yards_gained"), "passing_tds": td("pass"), "interceptions": F.col("interception")}),
        "rusher": (F.col("rush_attempt") == 1, "rusher_id", {"rush_attempts": F.lit(1), "rushing_yards": F.col("yards_gained"), "rushing_tds": td("rush")}),
        "receiver": (F.col("pass_attempt") == 1, "receiver_id", {"targets": F.lit(1), "receptions": F.col("complete_pass"), "receiving_yards": F.col("yards_gained"), "receiving_tds": td("pass")}),
        "fumbler": (F.col("fumble") == 1, None, {"fumbles_lost": F.lit(1)}),
    }
    structs = []
    for cond, who, adds in roles.values():
        player = F.col(who) if who else F.when(F.col("rush_attempt") == 1, F.col("rusher_id")).otherwise(F.col("receiver_id"))
        row = F.struct(player.alias("player_id"), *(F.coalesce(adds[s], F.lit(0)).cast("long").alias(s) if s in adds else F.lit(0).cast("long").alias(s) for s in STATS))
        structs.append(F.when(cond, row))
    rows = pbp.select("season", "week", F.explode(F.array_compact(F.array(*structs))).alias("r")).where("r.player_id is not null and r.player_id <> ''")
    return rows.groupBy("r.player_id", "season", "week").agg(*(F.sum(f"r.{s}").alias(s) for s in STATS))
