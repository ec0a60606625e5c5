"""Queries over scans, contract, aggregation, windows and valuation, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield import views as v
from tallyfield.operators import asof, contract, ingest, valuation
from tallyfield.operators.asof import AsOf
from tallyfield.registry import query
from tallyfield.schemas import STATS
from tallyfield.views import with_

AT = AsOf(1998, 6)
BEFORE = "(season < 1998 OR (season = 1998 AND week <= 5))"
SLOTS = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "FLEX": 1}


def states(spark, d):
    return ingest.with_next_state(v.plays(spark, d))


@query(with_("raw", "SELECT season, count(*) AS n_rows, count(DISTINCT game_id) AS n_games FROM raw WHERE season IN (1997, 1998) GROUP BY season"))
def s1_scan_seasons(spark, d):
    return v.raw_pbp(spark, d).where(F.col("season").isin(1997, 1998)).groupBy("season").agg(F.count("*").alias("n_rows"), F.count_distinct("game_id").alias("n_games"))


@query("""WITH r AS (SELECT 'p' || (o_custkey % 40) AS player_id, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderkey AS ord, CAST(c_nationkey AS VARCHAR) AS team
          FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT player_id, season, team FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, ord DESC) AS n FROM r) WHERE n = 1""")
def s14_latest_roster(spark, d):
    """The last row of a player over all seasons."""
    o, c = v.read(spark, d, "orders"), v.read(spark, d, "customer")
    r = o.join(c, o.o_custkey == c.c_custkey).select(F.expr("concat('p', o_custkey % 40)").alias("player_id"), F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("ord"), F.col("c_nationkey").cast("string").alias("team"))
    last = F.max_by(F.struct("season", "team"), F.struct("season", "ord"))
    return r.groupBy("player_id").agg(last.alias("x")).select("player_id", "x.season", "x.team")


@query(with_("history", "SELECT player_id, season, week, points FROM history"))
def s15_history(spark, d):
    return v.history(spark, d).select("player_id", "season", "week", "points")


@query(with_("plays", "SELECT season, count(*) AS n_rows, count(DISTINCT drive_id) AS n_drives, round(avg(CASE WHEN len(off_players) > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS participation FROM plays GROUP BY season"))
def k2_season_stats(spark, d):
    return ingest.season_stats(v.plays(spark, d))


@query(with_("players", """SELECT player_id, position, CASE WHEN id % 3 = 0 THEN 'T' || (id % 7) ELSE team END AS team
FROM (SELECT *, CAST(substr(player_id, 2) AS BIGINT) AS id FROM players)"""))
def k3_upsert_players(spark, d):
    """Rows of a newer roster over the stored ones; the last write of a key wins."""
    old = v.players(spark, d)
    n = old.withColumn("id", F.substring("player_id", 2, 9).cast("long")).where("id % 3 = 0")
    late = n.withColumn("team", F.expr("concat('T', id % 7)")).withColumn("ord", F.lit(2))
    early = n.withColumn("team", F.lit("stale")).withColumn("ord", F.lit(1))
    return asof.merge_rows(old, late.union(early), ["player_id"], "ord")


@query(with_("player_stats", "SELECT s.player_id, s.season, s.week, s.targets FROM player_stats s WHERE CAST(substr(s.player_id, 2) AS BIGINT) % 5 <> 0"))
def k4_upsert_known_stats(spark, d):
    known = v.player_stats(spark, d).select("player_id").distinct().where(F.substring("player_id", 2, 9).cast("long") % 5 != 0)
    return v.player_stats(spark, d).join(known, "player_id", "left_semi").select("player_id", "season", "week", "targets")


@query(with_("plays", "SELECT def_team AS team, p.position, round(avg(yards), 8) AS grade FROM plays, (VALUES ('QB'), ('RB'), ('WR'), ('TE')) p(position) GROUP BY ALL"))
def k5_grade_fanout(spark, d):
    g = v.plays(spark, d).groupBy(F.col("def_team").alias("team")).agg(F.round(F.avg("yards"), 8).alias("grade"))
    return g.select("team", F.explode(F.array(*map(F.lit, ("QB", "RB", "WR", "TE")))).alias("position"), "grade")


@query("SELECT n_name AS team, s.s_nationkey AS k, count(*) AS n FROM supplier s JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey < 10) GROUP BY ALL")
def k8_insert_or_ignore(spark, d):
    have = v.read(spark, d, "customer").where("c_custkey < 10").select(F.col("c_nationkey").alias("k"))
    new = v.read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).join(have, "k", "left_anti")
    n = v.read(spark, d, "nation")
    return new.join(n, F.col("k") == n.n_nationkey).groupBy(F.col("n_name").alias("team"), "k").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS label, 'r:' || (c_custkey % 3) || ';s:' || (c_custkey % 2) AS content FROM customer),
u AS (SELECT sha256(content) AS content_hash, min(label) AS label, min(id) AS first_id FROM c GROUP BY content)
SELECT content_hash, first_id, CASE WHEN n = 1 THEN label ELSE label || ' (' || n || ')' END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY first_id) AS n FROM u)""")
def k10_format_by_content(spark, d):
    """One format per content hash; a label used again is numbered."""
    c = v.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.expr("concat('r:', c_custkey % 3, ';s:', c_custkey % 2)").alias("content"))
    u = c.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.min("label").alias("label"), F.min("id").alias("first_id"))
    n = F.row_number().over(Window.partitionBy("label").orderBy("first_id"))
    return u.withColumn("n", n).select("content_hash", "first_id", F.when(F.col("n") == 1, F.col("label")).otherwise(F.format_string("%s (%d)", "label", "n")).alias("label"))


@query("SELECT c_custkey, '{\"id\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\"}' AS record FROM customer WHERE isfinite(c_acctbal)")
def k18_json_envelope(spark, d):
    c = v.read(spark, d, "customer").where(~F.isnan("c_acctbal") & (F.abs("c_acctbal") < float("inf")))
    return c.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))).alias("record"))


@query(r"""SELECT p_partkey, regexp_replace(x, '^([=+\-@\t\r])', '''\1') AS safe FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '=' ELSE '' END || p_name AS x FROM part)""")
def k19_csv_escape(spark, d):
    p = v.read(spark, d, "part").withColumn("x", F.concat(F.when(F.col("p_partkey") % 4 == 0, "=").otherwise(""), "p_name"))
    return p.select("p_partkey", F.regexp_replace("x", r"^([=+\-@\t\r])", "'$1").alias("safe"))


@query(with_("plays", "SELECT season, play_type, count(*) AS n FROM plays GROUP BY ALL"))
def p1_modelled_plays(spark, d):
    return v.plays(spark, d).groupBy("season", "play_type").agg(F.count("*").alias("n"))


@query(with_("raw", """SELECT game_id, play_id, drive_id, CASE WHEN play_type = 'pass' THEN 1 ELSE 0 END AS pass_attempt, CASE WHEN play_type = 'run' THEN 1 ELSE 0 END AS rush_attempt,
coalesce(down, 0) AS down, CASE WHEN result = 'Touchdown' AND play_type = 'pass' THEN 'pass' WHEN result = 'Touchdown' AND play_type = 'run' THEN 'rush' END AS td_type FROM raw"""))
def p2_stats_shape(spark, d):
    r = v.raw_pbp(spark, d)
    kind = lambda k: F.when(F.col("play_type") == k, 1).otherwise(0)
    td = F.when((F.col("result") == "Touchdown") & (F.col("play_type") == "pass"), "pass").when((F.col("result") == "Touchdown") & (F.col("play_type") == "run"), "rush")
    return r.select("game_id", "play_id", "drive_id", kind("pass").alias("pass_attempt"), kind("run").alias("rush_attempt"), F.coalesce("down", F.lit(0)).alias("down"), td.alias("td_type"))


@query(with_("raw", "SELECT drive_id, CASE result WHEN 'Touchdown' THEN 7 WHEN 'Field goal' THEN 3 ELSE 0 END AS drive_points, count(*) AS n FROM raw GROUP BY ALL"))
def p5_drive_points(spark, d):
    return v.raw_pbp(spark, d).groupBy("drive_id", ingest.drive_points(F.col("result"), "corrected").alias("drive_points")).agg(F.count("*").alias("n"))


@query(with_("plays", """SELECT situation, down, count(*) AS n, round(avg(drive_points), 8) AS mean_points FROM (
  SELECT *, unnest(list_filter([CASE WHEN yardline_100 <= 20 THEN 'red_zone' END, CASE WHEN (down = 3 AND ydstogo >= 7) OR down = 4 THEN 'passing_downs' END,
    CASE WHEN down <= 2 AND ydstogo <= 4 THEN 'rushing_downs' END, CASE WHEN clock <= 120 THEN 'two_minute' END], lambda x: x IS NOT NULL)) AS situation FROM plays) GROUP BY ALL"""))
def p7_situations(spark, d):
    s = ingest.situations(v.plays(spark, d))
    return s.groupBy("situation", "down").agg(F.count("*").alias("n"), F.round(F.avg("drive_points"), 8).alias("mean_points"))


@query(with_("plays", f"SELECT season, week, count(*) AS n FROM plays WHERE {BEFORE} GROUP BY ALL"))
def p8_asof_slice(spark, d):
    return AT.assert_clean(AT.slice_plays(v.plays(spark, d))).groupBy("season", "week").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, year(o_orderdate) AS season, month(o_orderdate) AS week FROM orders
WHERE (year(o_orderdate), month(o_orderdate)) < (1998, 6) AND o_orderdate + INTERVAL (o_orderkey % 40) DAY < TIMESTAMP '1998-05-20'""")
def p10_published_asof(spark, d):
    o = v.read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("season"), F.month("o_orderdate").cast("long").alias("week"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 40 as int))").alias("published_at"))
    return o.where(AT.published(F.lit("1998-05-20").cast("timestamp_ntz"))).drop("published_at")


@query(with_("plays", f"SELECT DISTINCT unnest(list_concat(off_players, def_players)) AS player_id FROM plays WHERE {BEFORE}"))
def p11_player_pool(spark, d):
    return AT.slice_pool(v.plays(spark, d))


@query(with_("plays", f"SELECT count(*) AS n_leaked FROM plays WHERE NOT {BEFORE}"))
def p12_tripwire(spark, d):
    return AT.leaked(v.plays(spark, d)).agg(F.count("*").alias("n_leaked"))


@query(with_("plays", f"SELECT season, week FROM plays WHERE {BEFORE} ORDER BY season DESC, week DESC LIMIT 1"))
def p13_watermark(spark, d):
    return asof.watermark(AT.slice_plays(v.plays(spark, d)))


@query(with_("plays", "SELECT season, week, row_number() OVER (ORDER BY season, week) - 1 AS slot FROM (SELECT DISTINCT season, week FROM plays)"))
def p15_ordered_slots(spark, d):
    s = v.plays(spark, d).select("season", "week").distinct()  # a calendar
    return s.withColumn("slot", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("season", "week")) - 1).cast("long"))


@query(with_("states players", """SELECT rule, count(*) AS n, count(DISTINCT drive_id) AS n_drives FROM (
  SELECT 'd1_yardline' AS rule, drive_id FROM states WHERE yardline_100 > 99 OR ydstogo > yardline_100
  UNION ALL SELECT 'd2_duplicate_id', drive_id FROM states WHERE len(list_distinct(off_players)) < len(off_players) OR len(list_distinct(def_players)) < len(def_players)
  UNION ALL SELECT 'r5_domain', drive_id FROM states WHERE NOT (down BETWEEN 1 AND 4 AND ydstogo >= 1 AND yardline_100 >= 1)
  UNION ALL SELECT 'r4_possession', drive_id FROM (SELECT DISTINCT drive_id FROM states WHERE off_team = def_team)
  UNION ALL SELECT DISTINCT 'r6_unknown_player', drive_id || '#' || play_id FROM (SELECT drive_id, play_id, unnest(list_concat(off_players, def_players)) AS player_id FROM states) WHERE player_id NOT IN (SELECT player_id FROM players WHERE player_id NOT IN ('p3', 'd7'))
) GROUP BY rule"""))
def p16_contract(spark, d):
    """Violations by rule, two players being left out of the universe."""
    known = v.players(spark, d).where(~F.col("player_id").isin("p3", "d7"))
    bad = contract.violations(states(spark, d), known)
    drive = F.when(F.col("rule") == "r6_unknown_player", F.concat_ws("#", "drive_id", "play_id")).otherwise(F.col("drive_id"))
    return bad.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct(drive).alias("n_drives"))


@query("SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY l_orderkey")
def p21_duplicate_keys(spark, d):
    k = v.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).where("c > 1")
    return k.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(with_("player_stats", " UNION ALL ".join(f"SELECT '{s}' AS column_name, count(*) FILTER ({s} <> 0) AS n_filled, count(*) FILTER ({s} <> 0) = 0 AS degraded FROM player_stats" for s in STATS)))
def p19_degraded_columns(spark, d):
    s = v.player_stats(spark, d).agg(*(F.count(F.when(F.col(c) != 0, 1)).alias(c) for c in STATS))
    long = s.select(F.expr("stack(" + str(len(STATS)) + ", " + ", ".join(f"'{c}', {c}" for c in STATS) + ") as (column_name, n_filled)"))
    return long.withColumn("degraded", F.col("n_filled") == 0)


ISLAND_ROWS = 200_000  # plays of a task


@query(with_("raw", """SELECT game_id, drive_id, min(r) AS first, max(r) AS last, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY game_id ORDER BY r) AS island FROM (
    SELECT *, CASE WHEN lag(drive_id) OVER (PARTITION BY game_id ORDER BY r) = drive_id THEN 0 ELSE 1 END AS new FROM (
      SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY play_id % 3, play_id, drive_id) AS r FROM raw))) GROUP BY game_id, island, drive_id"""))
def p24_drive_islands(spark, d):
    by = ["third", "play_id", "drive_id"]
    tasks = 1 + v.read(spark, d, "lineitem").count() // ISLAND_ROWS  # more plays are more tasks, not larger ones
    p = v.raw_pbp(spark, d).select("game_id", "drive_id", "play_id").repartition(tasks, "game_id").withColumn("third", F.expr("play_id % 3"))
    p = p.withColumn("row", F.row_number().over(Window.partitionBy("game_id").orderBy(*by)))
    return contract.drive_islands(p, "row", by).drop("island")


@query(with_("raw", "SELECT drive_id, play_id, len(list_filter(string_split(offense_players, ';'), lambda x: x <> '')) AS n_off FROM raw WHERE play_type IN ('pass', 'run') AND down IS NOT NULL"))
def j1_participation(spark, d):
    """Plays with participants from a frame of their own; no match gives no participants."""
    r = v.raw_pbp(spark, d)
    part = r.select("game_id", (F.col("play_id") * 1.0).alias("play_id"), "drive_id", "offense_players", "defense_players")
    p = ingest.build_plays(r.withColumn("game_id", F.col("drive_id")), part.withColumn("game_id", F.col("drive_id")))
    return p.select("drive_id", "play_id", F.size("off_players").cast("long").alias("n_off"))


@query(with_("plays players", """SELECT drive_id, play_id, list(player_id ORDER BY k) AS skill FROM (
  SELECT drive_id, play_id, unnest(off_players) AS player_id, unnest(range(len(off_players))) AS k FROM plays) JOIN players USING (player_id) WHERE position <> 'QB' GROUP BY ALL"""))
def j2_skill_participants(spark, d):
    e = v.plays(spark, d).select("drive_id", "play_id", F.posexplode("off_players").alias("k", "player_id"))
    e = e.join(v.players(spark, d).where("position <> 'QB'").select("player_id"), "player_id")
    return e.groupBy("drive_id", "play_id").agg(F.sort_array(F.collect_list(F.struct("k", "player_id"))).alias("x")).select("drive_id", "play_id", F.col("x.player_id").alias("skill"))


@query(with_("plays", "SELECT season, week, off_team, count(*) AS n FROM plays GROUP BY ALL"))
def a19_plays_per_offense(spark, d):
    return v.plays(spark, d).groupBy("season", "week", "off_team").agg(F.count("*").alias("n"))


_BOX_SQL = """, n AS (SELECT season, week, split_part(offense_players, ';', 1) AS a, split_part(offense_players, ';', 2) AS b, yards,
  CASE WHEN play_type = 'pass' THEN 1 ELSE 0 END AS pass_attempt, CASE WHEN play_type = 'run' THEN 1 ELSE 0 END AS rush_attempt,
  CASE WHEN clock % 2 = 0 THEN 1 ELSE 0 END AS complete_pass, CASE WHEN clock % 31 = 0 THEN 1 ELSE 0 END AS interception, CASE WHEN clock % 17 = 0 THEN 1 ELSE 0 END AS fumble,
  CASE WHEN result = 'Touchdown' THEN CASE play_type WHEN 'pass' THEN 'pass' WHEN 'run' THEN 'rush' END END AS td_type FROM raw WHERE play_type IN ('pass', 'run')),
r AS (SELECT season, week, a AS player_id, 1 AS pass_attempts, complete_pass AS completions, yards AS passing_yards, CAST(coalesce(td_type = 'pass', false) AS INTEGER) AS passing_tds, interception AS interceptions, 0 AS rush_attempts, 0 AS rushing_yards, 0 AS rushing_tds, 0 AS targets, 0 AS receptions, 0 AS receiving_yards, 0 AS receiving_tds, 0 AS fumbles_lost FROM n WHERE pass_attempt = 1
 UNION ALL SELECT season, week, a, 0, 0, 0, 0, 0, 1, yards, CAST(coalesce(td_type = 'rush', false) AS INTEGER), 0, 0, 0, 0, 0 FROM n WHERE rush_attempt = 1
 UNION ALL SELECT season, week, b, 0, 0, 0, 0, 0, 0, 0, 0, 1, complete_pass, yards, CAST(coalesce(td_type = 'pass', false) AS INTEGER), 0 FROM n WHERE pass_attempt = 1
 UNION ALL SELECT season, week, CASE WHEN rush_attempt = 1 THEN a ELSE b END, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1 FROM n WHERE fumble = 1)
SELECT player_id, season, week, """ + ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in STATS if s != "two_point_conversions") + ", 0::BIGINT AS two_point_conversions FROM r GROUP BY player_id, season, week"


@query(with_("raw", "").rstrip() + _BOX_SQL)
def a5_box_score(spark, d):
    """A1 to A4 in one aggregation: passing, rushing, receiving and fumbles."""
    r = v.raw_pbp(spark, d).where("play_type in ('pass', 'run')")
    ids = F.split("offense_players", ";")
    flag = lambda c: F.expr(f"case when {c} then 1 else 0 end")
    n = r.select(
        "season", "week", ids[0].alias("passer_id"), ids[0].alias("rusher_id"), ids[1].alias("receiver_id"), F.col("yards").alias("yards_gained"),
        flag("play_type = 'pass'").alias("pass_attempt"), flag("play_type = 'run'").alias("rush_attempt"), flag("clock % 2 = 0").alias("complete_pass"),
        flag("clock % 31 = 0").alias("interception"), flag("clock % 17 = 0").alias("fumble"),
        F.expr("case when result = 'Touchdown' then case play_type when 'pass' then 'pass' when 'run' then 'rush' end end").alias("td_type"),
    )
    return ingest.box_score(n)


_TOTALS = "totals AS (SELECT player_id, position, " + ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in STATS) + " FROM player_stats WHERE season = 2023 GROUP BY ALL)"


def totals(spark, d):
    return v.player_stats(spark, d).where("season = 2023").groupBy("player_id", "position").agg(*(F.sum(s).alias(s) for s in STATS))


@query(with_("player_stats", "SELECT * FROM totals", _TOTALS))
def a6_season_totals(spark, d):
    return totals(spark, d)


_POOL = "pool AS (SELECT f.name AS format, player_id, position, CASE f.name " + " ".join(f"WHEN '{n}' THEN {v.points_sql(r)}" for n, r in v.PROFILES.items()) + " END AS projected_points FROM totals, (VALUES ('Standard'), ('Half PPR'), ('Full PPR')) f(name))"


def pool(spark, d):
    """Points of every player under every profile, in one plan."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("format"), F.expr(v.points_sql(r)).alias("projected_points")) for n, r in v.PROFILES.items())))
    return totals(spark, d).select("player_id", "position", each.alias("f")).select("f.format", "player_id", "position", "f.projected_points")


@query(with_("player_stats", "SELECT * FROM pool", _TOTALS, _POOL))
def f1_fantasy_points(spark, d):
    return pool(spark, d)


_VOR = """lev AS (SELECT *, row_number() OVER (PARTITION BY format, position ORDER BY projected_points DESC, player_id) AS rn,
    CASE position WHEN 'QB' THEN 12 WHEN 'RB' THEN 24 WHEN 'WR' THEN 24 WHEN 'TE' THEN 12 END AS need,
    row_number() OVER (PARTITION BY format, position IN ('RB', 'WR', 'TE') ORDER BY projected_points DESC, player_id) AS frn FROM pool),
own AS (SELECT *, coalesce(max(CASE WHEN rn = need + 1 THEN projected_points END) OVER (PARTITION BY format, position), min(projected_points) OVER (PARTITION BY format, position)) AS o,
    coalesce(max(CASE WHEN frn = 73 THEN projected_points END) OVER (PARTITION BY format, position IN ('RB', 'WR', 'TE')), min(projected_points) OVER (PARTITION BY format, position IN ('RB', 'WR', 'TE'))) AS fl FROM lev),
val AS (SELECT format, player_id, position, projected_points, CASE WHEN position = 'QB' THEN o ELSE greatest(o, fl) END AS replacement FROM own),
ranked AS (SELECT *, projected_points - replacement AS vor, row_number() OVER (PARTITION BY format ORDER BY projected_points - replacement DESC, player_id) AS rank FROM val)"""


def valued(spark, d):
    return valuation.value_over_replacement(pool(spark, d), SLOTS, 12, ["format"])


@query(with_("player_stats", "SELECT format, player_id, position, projected_points, round(replacement, 8) AS replacement, round(vor, 8) AS vor, rank FROM ranked", _TOTALS, _POOL, _VOR))
def d1_value_over_replacement(spark, d):
    return valued(spark, d).select("format", "player_id", "position", "projected_points", F.round("replacement", 8).alias("replacement"), F.round("vor", 8).alias("vor"), "rank")


@query(with_("player_stats", """SELECT format, player_id, rank, CAST(sum(cut) OVER (PARTITION BY format ORDER BY rank) + 1 AS BIGINT) AS tier FROM (
SELECT *, CASE WHEN (pv - vor) / CASE WHEN pv = 0 THEN 1.0 ELSE abs(pv) END > CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END AS cut FROM (SELECT *, lag(vor) OVER (PARTITION BY format ORDER BY rank) AS pv FROM ranked))""", _TOTALS, _POOL, _VOR))
def d2_tiers(spark, d):
    return valuation.tiers(valued(spark, d), by=["format"]).select("format", "player_id", "rank", "tier")


@query(with_("plays", "SELECT season, id + 1 AS pick, id // n + 1 AS round, CASE WHEN (id // n) % 2 = 0 THEN id % n + 1 ELSE n - id % n END AS team FROM (SELECT season, n, unnest(range(n * 15)) AS id FROM (SELECT season, count(DISTINCT off_team) AS n FROM plays GROUP BY 1))"))
def d4_snake_order(spark, d):
    """A draft of 15 rounds for the teams of each season."""
    leagues = v.plays(spark, d).groupBy("season").agg(F.count_distinct("off_team").alias("teams"))
    return valuation.snake_order(leagues, 15).select("season", "pick", "round", "team")


@query()
def d5_draft(spark, d):
    """A greedy draft of the standard pool: 12 teams, 8 rounds, on the driver."""
    ranked = valuation.within_reach(valued(spark, d).where("format = 'Half PPR'"), 12 * 8, ["format"])
    got = valuation.draft([r.asDict() for r in ranked.select("player_id", "position", "rank").collect()], SLOTS, 12, 8)
    return spark.createDataFrame([(t + 1, k + 1, p["player_id"], p["position"]) for t, r in enumerate(got) for k, p in enumerate(r)] or [], "team int, round int, player_id string, position string")


_ROSTER = """roster AS (SELECT season, week, CAST(substr(player_id, 2) AS BIGINT) // 12 AS roster, player_id, position, points AS projection, CAST(substr(player_id, 2) AS BIGINT) % 11 = week AS is_out FROM history),
ded AS (SELECT *, row_number() OVER (PARTITION BY season, week, roster, position ORDER BY projection DESC, player_id) <= CASE position WHEN 'QB' THEN 1 WHEN 'RB' THEN 2 WHEN 'WR' THEN 2 ELSE 1 END AS dedicated FROM roster WHERE NOT is_out),
fl AS (SELECT *, NOT dedicated AND position IN ('RB', 'WR', 'TE') AS open FROM ded),
fr AS (SELECT *, row_number() OVER (PARTITION BY season, week, roster, open ORDER BY projection DESC, player_id) AS f FROM fl),
starters AS (SELECT * FROM fr WHERE dedicated OR (open AND f <= 1))"""


def roster(spark, d):
    n = F.substring("player_id", 2, 9).cast("long")
    return v.history(spark, d).select("season", "week", F.floor(n / 12).alias("roster"), "player_id", "position", F.col("points").alias("projection"), (n % 11 == F.col("week")).alias("is_out"))


@query(with_("history", "SELECT season, week, roster, player_id FROM starters", _ROSTER))
def d6_lineup(spark, d):
    return valuation.lineup(roster(spark, d), SLOTS, ["season", "week", "roster"]).select("season", "week", "roster", "player_id")


@query(with_("history", """SELECT season, count(*) AS n, round(avg(margin), 8) AS margin, round(avg(CASE WHEN margin > 0 THEN 1.0::DOUBLE WHEN margin = 0 THEN 0.5 ELSE 0 END), 8) AS win_rate FROM (
  SELECT season, week, roster, sum(projection) - sum(CASE WHEN dedicated THEN projection ELSE 0 END) AS margin FROM starters GROUP BY ALL) GROUP BY season""", _ROSTER))
def d7_weekly_margin(spark, d):
    """Margin of the lineup with FLEX over the one without, and its win rate."""
    by = ["season", "week", "roster"]
    r = roster(spark, d)
    full = valuation.lineup(r, SLOTS, by).groupBy(*by).agg(F.sum("projection").alias("a"))
    base = valuation.lineup(r, {k: n for k, n in SLOTS.items() if k != "FLEX"}, by).groupBy(*by).agg(F.sum("projection").alias("b"))
    m = full.join(base, by, "left").withColumn("m", F.col("a") - F.coalesce("b", F.lit(0.0)))
    return m.groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg("m"), 8).alias("margin"), F.round(F.avg(F.when(F.col("m") > 1e-9, 1.0).when(F.abs("m") <= 1e-9, 0.5).otherwise(0.0)), 8).alias("win_rate"))


@query(with_("player_stats", """SELECT count(*) FILTER (rank <= 5) AS in_top, count(*) FILTER (rank > 24) AS too_low, count(*) FILTER (rank IS NULL) AS missing,
count(*) FILTER (rank <= 5) >= 3 AND count(*) FILTER (rank > 24) = 0 AS passed FROM (VALUES ('u1'), ('u2'), ('u3'), ('u5'), ('nobody')) e(player_id) LEFT JOIN (SELECT * FROM ranked WHERE format = 'Standard') r USING (player_id)""", _TOTALS, _POOL, _VOR))
def p20_rank_bands(spark, d):
    elites = spark.createDataFrame([(x,) for x in ("u1", "u2", "u3", "u5", "nobody")], "player_id string")
    return valuation.rank_bands(valued(spark, d).where("format = 'Standard'"), elites)


@query(with_("states", "SELECT drive_id, play_id, n_down, n_ydstogo, n_yardline_100, terminal, terminal_value FROM states"))
def w1_next_state(spark, d):
    return states(spark, d).select("drive_id", "play_id", "n_down", "n_ydstogo", "n_yardline_100", "terminal", "terminal_value")


@query(with_("players", "SELECT player_id, row_number() OVER (ORDER BY player_id) - 1 AS col FROM players"))
def t2_canonical_columns(spark, d):
    """Ids as strings in byte order give the columns of the design."""
    w = Window.partitionBy(F.lit(0)).orderBy("player_id")  # one row a player
    return v.players(spark, d).select("player_id", (F.row_number().over(w) - 1).cast("long").alias("col"))


@query(with_("history", "SELECT player_id, points FROM history WHERE season = 2022 AND week = 3 ORDER BY points DESC, player_id LIMIT 10 OFFSET 5"))
def t6_page(spark, d):
    return v.history(spark, d).where("season = 2022 and week = 3").select("player_id", "points").orderBy(F.col("points").desc(), "player_id").offset(5).limit(10)


@query(with_("plays", "SELECT season, week FROM (SELECT season, week, row_number() OVER (ORDER BY season, week) - 1 AS k FROM (SELECT DISTINCT season, week FROM plays)) WHERE k % 4 = 0"))
def t7_origin_stride(spark, d):
    s = v.plays(spark, d).select("season", "week").distinct()
    return s.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("season", "week")) - 1).where("k % 4 = 0").drop("k")


@query(with_("history", "SELECT player_id FROM history WHERE season = 2022 UNION SELECT player_id FROM history WHERE season = 2023"))
def u3_id_union(spark, d):
    h = v.history(spark, d)
    return h.where("season = 2022").select("player_id").unionByName(h.where("season = 2023").select("player_id")).distinct()


@query(with_("history", "SELECT player_id FROM history WHERE season = 2022 EXCEPT SELECT player_id FROM history WHERE season = 2023 AND points > 20"))
def u6_id_difference(spark, d):
    h = v.history(spark, d)
    return h.where("season = 2022").select("player_id").subtract(h.where("season = 2023 and points > 20").select("player_id"))
