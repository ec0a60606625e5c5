"""Declared schemas of the engine's frames; nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T

STATS = [
    "pass_attempts", "completions", "passing_yards", "passing_tds", "interceptions", "rush_attempts", "rushing_yards",
    "rushing_tds", "targets", "receptions", "receiving_yards", "receiving_tds", "fumbles_lost", "two_point_conversions",
]

PLAYS = T.StructType(
    [
        T.StructField("game_id", T.StringType()),
        T.StructField("drive_id", T.StringType()),
        T.StructField("play_id", T.LongType()),
        T.StructField("season", T.IntegerType(), False),
        T.StructField("week", T.IntegerType(), False),
        T.StructField("off_team", T.StringType()),
        T.StructField("def_team", T.StringType()),
        T.StructField("down", T.IntegerType()),
        T.StructField("ydstogo", T.IntegerType()),
        T.StructField("yardline_100", T.IntegerType()),
        T.StructField("yards", T.IntegerType()),
        T.StructField("drive_points", T.IntegerType()),
        T.StructField("clock", T.IntegerType()),
        T.StructField("off_players", T.ArrayType(T.StringType())),
        T.StructField("def_players", T.ArrayType(T.StringType())),
    ]
)
PLAYERS = T.StructType([T.StructField("player_id", T.StringType(), False), T.StructField("position", T.StringType()), T.StructField("team", T.StringType())])
PLAYER_STATS = T.StructType(
    [T.StructField("player_id", T.StringType(), False), T.StructField("position", T.StringType()), T.StructField("season", T.IntegerType(), False), T.StructField("week", T.IntegerType(), False)]
    + [T.StructField(c, T.LongType()) for c in STATS]
)


def drift(found: T.StructType, declared: T.StructType) -> list[str]:
    """Columns that are absent from or typed differently than the declared schema."""
    have = {f.name: f.dataType for f in found}
    out = [f"{f.name}: absent" for f in declared if f.name not in have]
    return out + [f"{f.name}: {have[f.name].simpleString()}" for f in declared if f.name in have and have[f.name] != f.dataType]
