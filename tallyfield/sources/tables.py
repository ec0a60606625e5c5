"""Sources: declared-schema scans by season, TTL cache, rosters, JSON seeds, synthetic worlds."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.schemas import drift


def scan(spark: SparkSession, path: str, schema: T.StructType, seasons: list[int] | None = None, strict: bool = True) -> DataFrame:
    """Parquet under a declared schema; seasons prune partitions or row groups."""
    if strict and (odd := drift(spark.read.parquet(path).schema, schema)):
        raise ValueError(f"schema drift: {odd}")
    df = spark.read.schema(schema).parquet(path)
    return df.where(F.col("season").isin(seasons)) if seasons else df


def union_years(frames: list[DataFrame]) -> DataFrame:
    """Years with unlike columns as one frame; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def roster_shape(raw: DataFrame) -> DataFrame:
    """Provider rosters under one set of names; the first alias present counts."""
    alias = {"player_id": ["player_id", "gsis_id"], "name": ["name", "full_name", "player_name"], "team": ["team"], "position": ["position"], "season": ["season"]}
    pick = {k: next((a for a in v if a in raw.columns), None) for k, v in alias.items()}
    if pick["player_id"] is None:
        raise ValueError("a roster needs a player id")
    return raw.select(*(F.col(c).alias(k) for k, c in pick.items() if c))


def participation_shape(raw: DataFrame) -> DataFrame:
    game = next((c for c in ("game_id", "nflverse_game_id", "old_game_id") if c in raw.columns), None)
    if game is None:
        raise ValueError("participation needs a game id")
    return raw.select(F.col(game).alias("game_id"), F.col("play_id").cast("long").alias("play_id"), "offense_players", "defense_players")


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document of rows."""
    return spark.read.schema(schema).json(path, multiLine=True)


class ParquetCache:
    """Tables under a folder, each with the time it was written; old ones are misses."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str) -> str:
        return f"{self.root}/{key.translate(str.maketrans('/:', '__'))}"

    def put(self, key: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._at(key) + "/data")
        self.spark.createDataFrame([(json.dumps({"written": time.time()}),)], "value string").coalesce(1).write.mode("overwrite").text(self._at(key) + "/meta")

    def get(self, key: str, ttl_hours: float) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            written = json.loads(self.spark.read.text(self._at(key) + "/meta").first()[0])["written"]
            return self.spark.read.parquet(self._at(key) + "/data") if time.time() - written < ttl_hours * 3600 else None
        except AnalysisException:
            return None


def hash_uniform(*parts):
    """A number in [0, 1) fixed by its parts."""
    key = F.concat_ws("|", *(F.lit(p).cast("string") if not hasattr(p, "cast") else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def hash_normal(*parts):
    """Sum of twelve uniforms less six."""
    return sum((hash_uniform(k, *parts) for k in range(12)), F.lit(-6.0))


def synthetic_world(spark: SparkSession, teams: int = 12, weeks: int = 14, drives: int = 12, seed: int = 7, defence_from: str = "defence") -> tuple[DataFrame, DataFrame]:
    """(plays, players) with planted abilities, drawn by hashes.

    Each team has 4 starters and 4 backups on offence and 8 defenders; a play's gain follows
    the abilities on the field. ``defence_from="offence"`` draws defenders from the attacking
    team, the known defect of the original generator.
    """
    roles = F.array(*(F.lit(r) for r in ["QB", "RB", "WR", "TE"]))
    slots = spark.range(teams * 16).select((F.col("id") % teams).cast("int").alias("t"), F.expr(f"cast(id div {teams} as int)").alias("k"))
    players = slots.select(
        F.format_string("%s%d_%d", F.when(F.col("k") < 8, "o").otherwise("d"), "t", "k").alias("player_id"),
        F.col("t").cast("string").alias("team"),
        F.when(F.col("k") < 8, F.element_at(roles, F.col("k") % 4 + 1)).otherwise("DEF").alias("position"),
        (F.col("k") % 8 < 4).alias("is_starter"),
        (0.1 * hash_normal(seed, "ability", F.col("t"), F.col("k"))).alias("ability"),
    )
    # a circle schedule: in week w team a meets the one at (w - a) mod (teams - 1), the last team taking the gap
    games = spark.range(weeks * teams * drives).select(F.expr(f"cast(id div {teams * drives} as int) + 1").alias("week"), F.expr(f"cast(id div {drives} % {teams} as int)").alias("off"), F.expr(f"cast(id % {drives} as int)").alias("drive"))
    m = teams - 1
    pair = F.expr(f"case when off = {m} then pmod(week * {(m + 1) // 2}, {m}) when pmod(week - off, {m}) = off then {m} else pmod(week - off, {m}) end").cast("int")
    games = games.withColumn("def", pair).withColumn("n", (2 + F.floor(8 * hash_uniform(seed, "n", F.col("week"), F.col("off"), F.col("drive")))).cast("int"))
    p = games.withColumn("play_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))))
    key = [F.col("week"), F.col("off"), F.col("drive"), F.col("play_id")]
    side = F.col("off") if defence_from == "offence" else F.col("def")
    off = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.concat(F.lit("o"), F.col("off").cast("string"), F.lit("_"), (r + F.when(hash_uniform(seed, "o", r, *key) < 0.8, 0).otherwise(4)).cast("string")))
    dfn = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.concat(F.lit("d"), side.cast("string"), F.lit("_"), (8 + r + F.when(hash_uniform(seed, "d", r, *key) < 0.7, 0).otherwise(4)).cast("string")))
    p = p.withColumns({"off_players": off, "def_players": dfn, "season": F.lit(2023), "game_id": F.concat_ws("_", F.col("week").cast("string"), F.least("off", "def").cast("string"))})
    p = p.withColumn("drive_id", F.concat_ws("_", "game_id", F.col("off").cast("string"), F.col("drive").cast("string")))
    ids = p.select("drive_id", "play_id", F.explode(F.concat(F.transform("off_players", lambda x: F.struct(x.alias("player_id"), F.lit(1.0).alias("s"))), F.transform("def_players", lambda x: F.struct(x.alias("player_id"), F.lit(-1.0).alias("s"))))).alias("e")).select("drive_id", "play_id", "e.player_id", "e.s")
    edge = ids.join(players.select("player_id", "ability"), "player_id").groupBy("drive_id", "play_id").agg(F.sum(F.col("s") * F.col("ability")).alias("edge"))
    p = p.join(edge, ["drive_id", "play_id"]).withColumn("dv", F.col("edge") + 0.8 * hash_normal(seed, "noise", *key))
    drive = Window.partitionBy("drive_id")
    total = F.sum("dv").over(drive)
    plays = p.select(
        "game_id", "drive_id", "play_id", "season", "week", F.col("off").cast("string").alias("off_team"), F.col("def").cast("string").alias("def_team"),
        (1 + (F.col("play_id") - 1) % 4).cast("int").alias("down"), (1 + F.floor(10 * hash_uniform(seed, "togo", *key))).cast("int").alias("ydstogo"),
        (1 + F.floor(99 * hash_uniform(seed, "yard", *key))).cast("int").alias("yardline_100"), F.floor(F.col("dv") * 8).cast("int").alias("yards"),
        F.when(total > 1.5, 7).when(total > 0.5, 3).otherwise(0).alias("drive_points"), "off_players", "def_players", "dv",
    )
    return plays, players


def synthetic_feeder(players: DataFrame, factor: float = 0.35, rookies: float = 0.4, seed: int = 7) -> DataFrame:
    """A feeder league that shows abilities at a discount, with noise."""
    value = factor * F.col("ability") + 0.03 * hash_normal(seed, "feeder", F.col("player_id"))
    return players.select("player_id", "position", value.alias("feeder_sv"), (250 + F.floor(650 * hash_uniform(seed, "snaps", F.col("player_id")))).cast("int").alias("feeder_snaps"), (hash_uniform(seed, "rookie", F.col("player_id")) < rookies).alias("is_rookie"))
