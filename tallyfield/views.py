"""The driver's tables as play logs and weekly statistics, in Spark and as SQL CTEs.

An order is a drive, its line items are plays, an event is a box-score event of a player.
``RAW``, ``PLAYS``, ``PLAYERS`` and ``STATS_SQL`` are CTE bodies for DuckDB with the same rows
as the functions; ``with_(...)`` puts them before a statement in order of dependence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.schemas import STATS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pbp(spark: SparkSession, d: str, keyed: bool = False) -> DataFrame:
    """Play-by-play as a provider would give it, before any filter. ``keyed``: dealt by the drive's
    number, kept as ``drive_key``, which is moved and sorted with less work than its id."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    in_drive = Window.partitionBy("_play").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    # an order is a drive: orders and line items meet on the drive's id or number, by which plays are windowed later too, and are dealt once
    drive = lambda k: F.concat(F.lit("g"), F.expr(f"{k} div 8"), F.lit("_"), (F.col(k) % 8).cast("string"))
    key = F.col if keyed else drive
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("_drive", key("o_orderkey"))
    p = li.withColumn("_play", key("l_orderkey")).withColumn("play_id", F.row_number().over(in_drive).cast("long")).join(o, F.col("_play") == F.col("_drive"))
    game = F.concat(F.lit("g"), F.expr("o_orderkey div 8"))
    s = lambda x: F.expr(f"cast({x} as string)")
    return p.select(
        *([F.col("_drive").alias("drive_key")] if keyed else []),
        game.alias("game_id"),
        drive("o_orderkey").alias("drive_id") if keyed else F.col("_drive").alias("drive_id"),
        "play_id",
        F.year("o_orderdate").alias("season"),
        F.month("o_orderdate").alias("week"),
        s("c_nationkey").alias("off_team"),
        s("(c_nationkey + 1 + o_orderkey % 24) % 25").alias("def_team"),
        F.expr("case when l_quantity > 49 then null else 1 + (l_linenumber - 1) % 4 end").alias("down"),
        F.col("l_quantity").cast("int").alias("ydstogo"),
        F.expr("cast(1 + l_partkey % 99 as int)").alias("yardline_100"),
        (F.col("l_linenumber") * 2 - 3).alias("yards"),
        F.expr("case l_returnflag when 'A' then 'pass' when 'R' then 'run' else 'no_play' end").alias("play_type"),
        F.expr("case o_orderstatus when 'F' then 'Touchdown' when 'P' then 'Field goal' else 'Punt' end").alias("result"),
        F.expr("cast((l_suppkey * 37 + l_partkey) % 900 as int)").alias("clock"),
        F.concat_ws(";", s("'p' || o_custkey % 40"), s("'p' || (40 + l_partkey % 40)")).alias("offense_players"),
        F.concat_ws(";", s("'d' || l_suppkey % 30"), s("'d' || (30 + (l_partkey + l_linenumber) % 30)")).alias("defense_players"),
    )


RAW = """raw AS (
  SELECT 'g' || (o_orderkey // 8) AS game_id, 'g' || (o_orderkey // 8) || '_' || (o_orderkey % 8) AS drive_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS play_id,
         CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week,
         CAST(c_nationkey AS VARCHAR) AS off_team, CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS VARCHAR) AS def_team,
         CASE WHEN l_quantity > 49 THEN NULL ELSE 1 + (l_linenumber - 1) % 4 END AS down,
         CAST(l_quantity AS INTEGER) AS ydstogo, CAST(1 + l_partkey % 99 AS INTEGER) AS yardline_100,
         l_linenumber * 2 - 3 AS yards,
         CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'run' ELSE 'no_play' END AS play_type,
         CASE o_orderstatus WHEN 'F' THEN 'Touchdown' WHEN 'P' THEN 'Field goal' ELSE 'Punt' END AS result,
         CAST((l_suppkey * 37 + l_partkey) % 900 AS INTEGER) AS clock,
         'p' || (o_custkey % 40) || ';p' || (40 + l_partkey % 40) AS offense_players,
         'd' || (l_suppkey % 30) || ';d' || (30 + (l_partkey + l_linenumber) % 30) AS defense_players
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def plays(spark: SparkSession, d: str) -> DataFrame:
    """Modelled plays with drive points and participants."""
    from tallyfield.operators.ingest import build_plays

    return build_plays(raw_pbp(spark, d))


def states(spark: SparkSession, d: str) -> DataFrame:
    """The same plays with the state after each, dealt once, by the drive's number."""
    from tallyfield.operators.ingest import build_plays

    return build_plays(raw_pbp(spark, d, keyed=True), next_by="drive_key")


PLAYS = """plays AS (
  SELECT game_id, drive_id, play_id, season, week, off_team, def_team, down, ydstogo, yardline_100, yards, play_type, clock,
         CASE result WHEN 'Touchdown' THEN 7 WHEN 'Field goal' THEN 3 ELSE 0 END AS drive_points,
         string_split(offense_players, ';') AS off_players, string_split(defense_players, ';') AS def_players
  FROM raw WHERE play_type IN ('pass', 'run') AND down IS NOT NULL)"""
STATES = """states AS (
  SELECT *, lead(down) OVER w AS n_down, lead(ydstogo) OVER w AS n_ydstogo, lead(yardline_100) OVER w AS n_yardline_100,
         lead(play_id) OVER w IS NULL AS terminal,
         CASE WHEN lead(play_id) OVER w IS NULL THEN drive_points END AS terminal_value
  FROM plays WINDOW w AS (PARTITION BY drive_id ORDER BY play_id))"""


def players(spark: SparkSession, d: str) -> DataFrame:
    """Universe: 80 offensive and 60 defensive players."""
    n = spark.range(140)
    return n.select(
        F.expr("case when id < 80 then concat('p', id) else concat('d', id - 80) end").alias("player_id"),
        F.expr("case when id >= 80 then 'DEF' else element_at(array('QB', 'RB', 'WR', 'TE'), cast(id % 4 as int) + 1) end").alias("position"),
        F.expr("cast(id % 25 as string)").alias("team"),
    )


PLAYERS = """players AS (
  SELECT CASE WHEN id < 80 THEN 'p' || id ELSE 'd' || (id - 80) END AS player_id,
         CASE WHEN id >= 80 THEN 'DEF' ELSE ['QB', 'RB', 'WR', 'TE'][CAST(id % 4 AS INTEGER) + 1] END AS position,
         CAST(id % 25 AS VARCHAR) AS team
  FROM range(140) t(id))"""

# statistic -> event type and what an event adds
_STAT = {
    "pass_attempts": ("view", "1"), "completions": ("view", "k % 2"), "passing_yards": ("view", "v"), "passing_tds": ("view", "CASE WHEN k < 10 THEN 1 ELSE 0 END"),
    "interceptions": ("error", "CASE WHEN k < 20 THEN 1 ELSE 0 END"), "rush_attempts": ("click", "1"), "rushing_yards": ("click", "v"), "rushing_tds": ("click", "CASE WHEN k < 12 THEN 1 ELSE 0 END"),
    "targets": ("purchase", "1"), "receptions": ("purchase", "k % 2"), "receiving_yards": ("purchase", "v"), "receiving_tds": ("purchase", "CASE WHEN k < 15 THEN 1 ELSE 0 END"),
    "fumbles_lost": ("error", "CASE WHEN k >= 90 THEN 1 ELSE 0 END"), "two_point_conversions": ("signup", "CASE WHEN k < 5 THEN 1 ELSE 0 END"),
}


def box_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as (player_id, position, season, week, event_type, v, k): ten days a season."""
    e = read(spark, d, "events")
    day = F.dayofmonth("ts") - 1
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("player_id"),
        F.expr("element_at(array('QB', 'RB', 'WR', 'TE'), cast(user_id % 4 as int) + 1)").alias("position"),
        (2022 + F.floor(day / 10)).cast("int").alias("season"),
        (day % 10 + 1).cast("int").alias("week"),
        "event_type",
        F.floor("value").cast("long").alias("v"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


BOX = """box AS (
  SELECT 'u' || user_id AS player_id, ['QB', 'RB', 'WR', 'TE'][CAST(user_id % 4 AS INTEGER) + 1] AS position,
         CAST(2022 + (day(ts) - 1) // 10 AS INTEGER) AS season, CAST((day(ts) - 1) % 10 + 1 AS INTEGER) AS week, event_type,
         CAST(floor(value) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def player_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row a player and week, 14 statistics."""
    sums = [F.expr(f"cast(sum(case when event_type = '{t}' then {v} else 0 end) as bigint)").alias(s) for s, (t, v) in _STAT.items()]
    return box_events(spark, d).groupBy("player_id", "position", "season", "week").agg(*sums)


STATS_SQL = (
    "player_stats AS (SELECT player_id, position, season, week, "
    + ", ".join(f"CAST(sum(CASE WHEN event_type = '{t}' THEN {v} ELSE 0 END) AS BIGINT) AS {s}" for s, (t, v) in _STAT.items())
    + " FROM box GROUP BY player_id, position, season, week)"
)
assert list(_STAT) == STATS

RULES: dict[str, float] = {
    "passing_yards": 0.04, "passing_tds": 4.0, "interceptions": -2.0, "rushing_yards": 0.1, "rushing_tds": 6.0,
    "receiving_yards": 0.1, "receiving_tds": 6.0, "fumbles_lost": -2.0, "two_point_conversions": 2.0,
}
PROFILES: dict[str, dict[str, float]] = {name: {**RULES, "receptions": r} for name, r in (("Standard", 0.0), ("Half PPR", 0.5), ("Full PPR", 1.0))}


def points_sql(rules: dict[str, float] = PROFILES["Half PPR"]) -> str:
    """Scoring as SQL: a sum over hundredths, exact in integers, then one division."""
    return "CAST(" + " + ".join(f"{round(w * 100)} * {s}" for s, w in rules.items() if w) + " AS DOUBLE) / 100"


HISTORY = f"history AS (SELECT player_id, position, season, week, {points_sql()} AS points FROM player_stats)"


def history(spark: SparkSession, d: str) -> DataFrame:
    """Realised points a player and week."""
    return player_stats(spark, d).select("player_id", "position", "season", "week", F.expr(points_sql()).alias("points"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as run records of sources: when they began and ended, and how."""
    k = F.get_json_object("props", "$.k").cast("long")
    state = F.when(k >= 97, "running").when(k < 8, "failed").otherwise("done")
    ends = F.col("ts") + F.expr("make_dt_interval(0, 0, 0, floor(value))")
    return read(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("source"), F.col("user_id").alias("model"), F.col("ts").alias("started_at"),
        F.when(state != "running", ends).alias("finished_at"), state.alias("state"),
    )


RUNS = """runs AS (SELECT event_id AS run_id, event_type AS source, user_id AS model, ts AS started_at,
  CASE WHEN k < 97 THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) END AS finished_at, CASE WHEN k >= 97 THEN 'running' WHEN k < 8 THEN 'failed' ELSE 'done' END AS state
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """Customers as provider identities that are linked to players, some pending."""
    c = read(spark, d, "customer")
    return c.select(
        F.concat(F.lit("x"), "c_custkey").alias("provider_id"), F.concat(F.lit("u"), F.col("c_custkey") % 150).alias("player_id"), F.expr("cast(1 + c_nationkey % 3 as int)").alias("tier"),
        F.round(F.expr("(c_custkey * 37 % 1000) / 1000.0D"), 3).alias("confidence"), F.when(F.col("c_custkey") % 4 == 0, "pending").when(F.col("c_custkey") % 4 == 1, "rejected").otherwise("approved").alias("state"),
    )


LINKS = """links AS (SELECT 'x' || c_custkey AS provider_id, 'u' || (c_custkey % 150) AS player_id, CAST(1 + c_nationkey % 3 AS INTEGER) AS tier, round((c_custkey * 37 % 1000) / 1000.0::DOUBLE, 3) AS confidence,
  CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'approved' END AS state FROM customer)"""


def models(spark: SparkSession, d: str) -> DataFrame:
    """Parts as model versions of families, one in production in most of them."""
    p = read(spark, d, "part")
    first = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return p.select(
        F.col("p_brand").alias("family"), F.concat(F.lit("v"), "p_partkey").alias("version"), F.col("p_partkey").alias("created"),
        F.when((F.row_number().over(first) == 1) & (F.col("p_size") > 5), "champion").when(F.col("p_size") % 2 == 0, "candidate").otherwise("retired").alias("role"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).alias("validated"),
    )


MODELS = """models AS (SELECT p_brand AS family, 'v' || p_partkey AS version, p_partkey AS created,
  CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1 AND p_size > 5 THEN 'champion' WHEN p_size % 2 = 0 THEN 'candidate' ELSE 'retired' END AS role,
  CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS validated FROM part)"""

_ALL = {"runs": (RUNS, ()), "links": (LINKS, ()), "models": (MODELS, ()), "raw": (RAW, ()), "plays": (PLAYS, ("raw",)), "states": (STATES, ("plays",)), "players": (PLAYERS, ()), "box": (BOX, ()), "player_stats": (STATS_SQL, ("box",)), "history": (HISTORY, ("player_stats",))}


def with_(names: str, statement: str, *more: str) -> str:
    """``statement`` under the named CTEs, what they need, and ``more`` CTEs."""
    need: list[str] = []

    def add(n: str) -> None:
        for x in _ALL[n][1]:
            add(x)
        if n not in need:
            need.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join([*(_ALL[n][0] for n in need), *more]) + "\n" + statement
