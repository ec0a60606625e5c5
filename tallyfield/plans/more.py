"""Further queries: shapes, joins, output records, reports and read models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield import views as v
from tallyfield.operators import asof, attribution, evaluation, ingest, records, valuation
from tallyfield.operators.asof import AsOf
from tallyfield.plans.models import CELLS, DV, GRAM, TRIPLETS, gram_of_states, series
from tallyfield.plans.relational import _POOL, _TOTALS, _VOR, pool
from tallyfield.registry import query
from tallyfield.sources import tables
from tallyfield.views import with_

R = lambda c, name=None: F.round(c, 8).alias(name or c)


@query("SELECT 'c' || c_custkey AS player_id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS team FROM customer")
def p4_roster_shape(spark, d):
    raw = v.read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("gsis_id"), F.col("c_name").alias("full_name"), F.col("c_nationkey").cast("string").alias("team"))
    return tables.roster_shape(raw)


@query(with_("raw", "SELECT game_id, play_id, drive_id, offense_players, defense_players FROM raw"))
def p3_participation_shape(spark, d):
    raw = v.raw_pbp(spark, d).select(F.col("game_id").alias("nflverse_game_id"), F.col("play_id").cast("double").alias("play_id"), "drive_id", "offense_players", "defense_players")
    ids = raw.select("drive_id", F.col("nflverse_game_id").alias("game_id"), F.col("play_id").cast("long").alias("play_id"))
    part = tables.participation_shape(raw.withColumn("nflverse_game_id", F.concat_ws("#", "nflverse_game_id", "drive_id")))
    return ids.join(part.select(F.split("game_id", "#")[1].alias("drive_id"), "play_id", "offense_players", "defense_players"), ["drive_id", "play_id"]).select("game_id", "play_id", "drive_id", "offense_players", "defense_players")


@query("SELECT 'g' || (o_orderkey // 8) || '_' || (o_orderkey % 8) AS drive_id, count(*) AS n FROM orders GROUP BY 1")
def p6_drive_id(spark, d):
    o = v.read(spark, d, "orders")
    return o.groupBy(F.concat_ws("_", F.concat(F.lit("g"), F.expr("o_orderkey div 8")), (F.col("o_orderkey") % 8).cast("double").cast("bigint").cast("string")).alias("drive_id")).agg(F.count("*").alias("n"))


@query(with_("plays", "SELECT season, week, off_team AS team, round(avg(drive_points), 8) AS strength FROM plays WHERE season < 1998 OR (season = 1998 AND week <= 6) GROUP BY ALL"))
def p9_asof_market(spark, d):
    """Pre-game facts count up to the week itself."""
    m = v.plays(spark, d).groupBy("season", "week", F.col("off_team").alias("team")).agg(R(F.avg("drive_points"), "strength"))
    return m.where(AsOf(1998, 6).pregame)


_REC = """rec AS (SELECT player_id, position, season, week, pass_attempts AS att, completions AS comp, targets AS tgt, receptions AS rec, passing_yards / 100.0::DOUBLE AS sd,
 (passing_tds + receiving_tds) / 2.0::DOUBLE AS p_td, CASE WHEN pass_attempts + targets > 2 THEN 1.0::DOUBLE ELSE 0.0 END AS p_active, count(*) OVER (PARTITION BY player_id, season, week) AS n_same,
 passing_yards * 0.5::DOUBLE AS q10, passing_yards * 1.0::DOUBLE AS q50,
 CASE WHEN week = 9 AND passing_yards = 0 THEN 'nan'::DOUBLE ELSE passing_yards * 1.5::DOUBLE - 3 * (week % 4 = 0)::INTEGER * passing_yards END AS q90 FROM player_stats)"""


@query(with_("player_stats", """SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN comp > att THEN 'comp_le_att' END, CASE WHEN rec > tgt THEN 'rec_le_tgt' END, CASE WHEN p_td NOT BETWEEN 0 AND 1 THEN 'probability' END,
 CASE WHEN NOT (q10 <= q50 AND q50 <= q90) THEN 'quantiles' END, CASE WHEN sd < 0 THEN 'spread' END, CASE WHEN position <> 'QB' AND att > 0 THEN 'component' END,
 CASE WHEN NOT isfinite(q10) OR NOT isfinite(q50) OR NOT isfinite(q90) THEN 'finite' END, CASE WHEN p_active = 0 AND (att <> 0 OR comp <> 0 OR tgt <> 0 OR rec <> 0 OR q50 <> 0) THEN 'inactive_zero' END,
 CASE WHEN position = 'QB' AND (tgt > 0 OR rec > 0) THEN 'receiver' END, CASE WHEN n_same > 1 THEN 'unique' END], lambda x: x IS NOT NULL)) AS rule FROM rec) GROUP BY rule""", _REC))
def p17_output_invariants(spark, d):
    s = v.player_stats(spark, d)
    y = F.col("passing_yards")
    q90 = F.when((F.col("week") == 9) & (y == 0), float("nan")).otherwise(y * 1.5 - F.when(F.col("week") % 4 == 0, 3).otherwise(0) * y)
    rec = s.select(
        "player_id", "position", "season", "week", F.col("pass_attempts").alias("att"), F.col("completions").alias("comp"), F.col("targets").alias("tgt"), F.col("receptions").alias("rec"), (y / 100).alias("sd"),
        ((F.col("passing_tds") + F.col("receiving_tds")) / 2).alias("p_td"), F.when(F.col("pass_attempts") + F.col("targets") > 2, 1.0).otherwise(0.0).alias("p_active"),
        F.count("*").over(Window.partitionBy("player_id", "season", "week")).alias("n_same"), (y * 0.5).alias("q10"), (y * 1.0).alias("q50"), q90.alias("q90"),
    )
    return records.broken(rec).groupBy("rule").agg(F.count("*").alias("n"))


# The contract's rows, written out by themselves and not from the operator's table.
_VOCABULARY = """SELECT component, unnest(CASE who WHEN 'all' THEN ['QB', 'RB', 'WR', 'TE'] WHEN 'qb' THEN ['QB'] ELSE ['RB', 'WR', 'TE'] END) AS position, unit FROM (VALUES
 ('active_probability', 'all', 'probability'), ('start_probability', 'qb', 'probability'), ('offensive_snap_share', 'skill', 'share'),
 ('pass_attempts', 'qb', 'count'), ('completions', 'qb', 'count'), ('passing_yards', 'qb', 'yards'), ('passing_tds', 'qb', 'count'), ('interceptions', 'qb', 'count'), ('sacks_taken', 'qb', 'count'),
 ('rushing_attempts', 'all', 'count'), ('rushing_yards', 'all', 'yards'), ('rushing_tds', 'all', 'count'),
 ('targets', 'skill', 'count'), ('receptions', 'skill', 'count'), ('receiving_yards', 'skill', 'yards'), ('receiving_tds', 'skill', 'count'),
 ('fumbles_lost', 'all', 'count'), ('two_point_conversions', 'all', 'count')) t(component, who, unit)"""


@query(with_("player_stats", f"SELECT vc.*, coalesce(n, 0) AS n_players FROM ({_VOCABULARY}) vc LEFT JOIN (SELECT position, count(DISTINCT player_id) AS n FROM player_stats GROUP BY 1) USING (position)"))
def p18_components(spark, d):
    """Which components a position may have, and how many players of it there are."""
    have = v.player_stats(spark, d).groupBy("position").agg(F.count_distinct("player_id").alias("n_players"))
    return records.component_table(spark).join(have, "position", "left").na.fill(0, ["n_players"])


@query("SELECT c_nationkey AS k, min(c_custkey) AS first FROM customer GROUP BY 1")
def p22_keep_first(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return v.read(spark, d, "customer").withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("first"))


@query(with_("states", "SELECT drive_id, play_id, coalesce(n_down, -1) AS n_down, coalesce(n_ydstogo, -1) AS n_ydstogo, coalesce(n_yardline_100, -1) AS n_yardline_100, coalesce(CAST(terminal_value AS DOUBLE), 'nan'::DOUBLE) AS terminal_value FROM states"))
def p23_legacy_columns(spark, d):
    """Terminal rows with -1 and NaN, as older consumers expect them."""
    s = ingest.with_next_state(v.plays(spark, d))
    return records.to_legacy(s).select("drive_id", "play_id", "n_down", "n_ydstogo", "n_yardline_100", "terminal_value")


@query("SELECT c_custkey AS player_id, count(o_orderkey) AS games, CAST(coalesce(sum(CASE WHEN o_orderkey IS NOT NULL THEN 1 END), 0) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND year(o_orderdate) = 1997 GROUP BY 1")
def j4_season_left_join(spark, d):
    """The season stands in the join, so players without it stay."""
    c, o = v.read(spark, d, "customer"), v.read(spark, d, "orders")
    j = c.join(o, (c.c_custkey == o.o_custkey) & (F.year("o_orderdate") == 1997), "left")
    return j.groupBy(F.col("c_custkey").alias("player_id")).agg(F.count("o_orderkey").alias("games"), F.coalesce(F.sum(F.when(F.col("o_orderkey").isNotNull(), 1)), F.lit(0)).cast("long").alias("n"))


_CHANGES = "(VALUES ('3', 'HC'), ('5', 'OC'), ('9', 'DC')) ch(team, role)"


@query(with_("players", f"SELECT DISTINCT player_id FROM players JOIN {_CHANGES} USING (team) WHERE CASE WHEN role = 'DC' THEN position = 'DEF' ELSE position <> 'DEF' END"))
def j11_coaching_changes(spark, d):
    changes = spark.createDataFrame([("3", "HC"), ("5", "OC"), ("9", "DC")], "team string, role string")
    hit = F.when(F.col("role") == "DC", F.col("position") == "DEF").otherwise(F.col("position") != "DEF")
    return v.players(spark, d).join(changes, "team").where(hit).select("player_id").distinct()


@query(with_("player_stats", "SELECT position, round(avg(t), 8) AS targets_pg FROM (SELECT position, player_id, sum(targets) / count(DISTINCT week)::DOUBLE AS t FROM player_stats WHERE season = 2022 GROUP BY ALL) GROUP BY position"))
def a10_position_means(spark, d):
    g = v.player_stats(spark, d).where("season = 2022").groupBy("position", "player_id").agg((F.sum("targets") / F.count_distinct("week")).alias("t"))
    return g.groupBy("position").agg(R(F.avg("t"), "targets_pg"))


@query(with_("plays players", "SELECT team, round(count(*) FILTER (t2 = def_team) / count(*)::DOUBLE, 8) AS share FROM (SELECT def_team AS team, def_team, p.team AS t2 FROM (SELECT def_team, unnest(def_players) AS player_id FROM plays) JOIN players p USING (player_id)) GROUP BY team"))
def a20_defender_team_share(spark, d):
    e = v.plays(spark, d).select("def_team", F.explode("def_players").alias("player_id")).join(v.players(spark, d).select("player_id", F.col("team").alias("t2")), "player_id")
    return e.groupBy(F.col("def_team").alias("team")).agg(R(F.avg((F.col("t2") == F.col("def_team")).cast("double")), "share"))


@query(with_("history", "SELECT player_id, min_by(season * 100 + week, points - prev) AS slot, round(min(points - prev), 8) AS drop FROM (SELECT *, lag(points) OVER (PARTITION BY player_id ORDER BY season, week) AS prev FROM history) WHERE prev IS NOT NULL GROUP BY player_id HAVING count(DISTINCT points - prev) = count(*)"))
def w10_steepest_drop(spark, d):
    w = Window.partitionBy("player_id").orderBy("season", "week")
    h = v.history(spark, d).withColumn("step", F.col("points") - F.lag("points").over(w)).where("step is not null")
    g = h.groupBy("player_id").agg(F.min_by(F.col("season") * 100 + F.col("week"), "step").alias("slot"), R(F.min("step"), "drop"), F.count_distinct("step").alias("u"), F.count("*").alias("n"))
    return g.where("u = n").select("player_id", "slot", "drop")


@query("SELECT year(o_orderdate) AS season, count(*) AS n, count(o_orderpriority) FILTER (year(o_orderdate) = 1996) AS with_extra FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1")
def u1_union_years(spark, d):
    """Years with unlike columns."""
    o = v.read(spark, d, "orders").withColumn("season", F.year("o_orderdate").cast("long"))
    both = tables.union_years([o.where("season = 1995").drop("o_orderpriority"), o.where("season = 1996")])
    return both.groupBy("season").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("with_extra"))


@query(with_("history", "SELECT player_id FROM (SELECT player_id FROM history WHERE season = 2022 AND week = 1 ORDER BY points DESC, player_id LIMIT 30) INTERSECT SELECT player_id FROM (SELECT player_id FROM history WHERE season = 2022 AND week = 2 ORDER BY points DESC, player_id LIMIT 30)"))
def u5_top_intersection(spark, d):
    top = lambda w: v.history(spark, d).where(f"season = 2022 and week = {w}").orderBy(F.col("points").desc(), "player_id").limit(30).select("player_id")
    return top(1).intersect(top(2))


@query(with_("player_stats", "SELECT format, count(*) AS n, CAST(sum(tier) AS BIGINT) AS tier_sum, round(sum(vor), 7) AS vor_sum FROM (SELECT format, vor, sum(cut) OVER (PARTITION BY format ORDER BY rank) + 1 AS tier FROM (SELECT *, CASE WHEN (pv - vor) / CASE WHEN pv = 0 THEN 1.0 ELSE abs(pv) END > CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END AS cut FROM (SELECT *, lag(vor) OVER (PARTITION BY format ORDER BY rank) AS pv FROM ranked))) GROUP BY format", _TOTALS, _POOL, _VOR))
def d3_valuation_run(spark, d):
    """Season totals, three formats, values, ranks and tiers in one plan."""
    t = valuation.tiers(valuation.value_over_replacement(pool(spark, d), {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "FLEX": 1}, 12, ["format"]), by=["format"])
    return t.groupBy("format").agg(F.count("*").alias("n"), F.sum("tier").alias("tier_sum"), F.round(F.sum("vor"), 6).alias("vor_sum"))


@query()
def d8_matchup_grades(spark, d):
    """Minus the defensive intercept of each team, for the four positions."""
    g = gram_of_states(spark, d, [])
    rows = [(k[2:], -b) for k, b in sorted(attribution.solve_ridge(g).items()) if k.startswith("d:")]
    return spark.createDataFrame(rows, "team string, grade double").select("team", F.explode(F.array(*map(F.lit, ("QB", "RB", "WR", "TE")))).alias("position"), "grade")


_T2 = "t2 AS (SELECT season, week, def_team, avg(yards) AS grade, avg(drive_points) AS allowed FROM plays GROUP BY ALL), rk AS (SELECT *, rank() OVER (PARTITION BY season, week ORDER BY grade) + (count(*) OVER (PARTITION BY season, week, grade) - 1) / 2.0 AS a, rank() OVER (PARTITION BY season, week ORDER BY allowed) + (count(*) OVER (PARTITION BY season, week, allowed) - 1) / 2.0 AS b FROM t2)"


@query(with_("plays", "SELECT season, week, count(*) AS n, round(CASE WHEN stddev_pop(a) * stddev_pop(b) = 0 THEN 0 ELSE corr(a, b) END, 8) AS spearman FROM rk GROUP BY ALL HAVING count(*) >= 6", _T2))
def e17_grade_report(spark, d):
    """Rank agreement of a defence's grade with the points it allowed, six teams a week or more."""
    t = v.plays(spark, d).groupBy("season", "week", "def_team").agg(F.avg("yards").alias("grade"), F.avg("drive_points").alias("allowed"))
    return evaluation.spearman(t, "grade", "allowed", ["season", "week"]).where("n >= 6").select("season", "week", "n", R("spearman"))


@query(with_("states", "SELECT i, round(sum(v), 7) AS v FROM gram WHERE j IS NULL AND (season < 1997 OR (season = 1997 AND week <= 5)) GROUP BY i", CELLS, DV, TRIPLETS, GRAM))
def e13_origin_sums(spark, d):
    """X'y at an origin, from the blocks of earlier slots."""
    g = gram_of_states(spark, d)
    return g.where(AsOf(1997, 6).outcome & F.col("j").isNull()).groupBy("i").agg(F.round(F.sum("v"), 7).alias("v"))


@query(with_("raw", "SELECT season, count(*) AS raw_rows, count(*) FILTER (play_type IN ('pass', 'run') AND down IS NOT NULL) AS kept_rows, count(*) FILTER (down IS NULL) AS no_down, count(*) FILTER (play_type NOT IN ('pass', 'run')) AS other_plays FROM raw GROUP BY season"))
def qy11_data_quality(spark, d):
    r = v.raw_pbp(spark, d)
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return r.groupBy("season").agg(F.count("*").alias("raw_rows"), n("play_type in ('pass', 'run') and down is not null").alias("kept_rows"), n("down is null").alias("no_down"), n("play_type not in ('pass', 'run')").alias("other_plays"))


@query()
def qy12_player_ratings(spark, d):
    """Rating, last filtered talent and variance, and weekly usage of a player, side by side."""
    from tallyfield.operators import statespace

    f = statespace.filtered(series(spark, d))
    last = F.max_by(F.struct("x0", "var"), F.struct("season", "week"))
    talent = f.groupBy("player_id").agg(last.alias("s")).select("player_id", F.col("s.x0").alias("talent"), F.col("s.var").alias("pred_var"))
    usage = v.player_stats(spark, d).groupBy("player_id").agg(F.avg("targets").alias("targets_pg"))
    return usage.join(talent, "player_id", "full")


@query(with_("history", "SELECT h.player_id, h.season, h.week, round(h.points, 8) AS points FROM history h WHERE NOT (h.season = 2023 AND h.week = 3) UNION ALL SELECT player_id, season, week, round(points + 1, 8) FROM history WHERE season = 2023 AND week = 3"))
def k7_corrected_week(spark, d):
    """A corrected week replaces its rows; running it twice changes nothing more."""
    h = v.history(spark, d).select("player_id", "season", "week", "points")
    fix = h.where("season = 2023 and week = 3").withColumn("points", F.col("points") + 1)
    once = asof.merge_rows(h, fix, ["player_id", "season", "week"])
    return asof.merge_rows(once, fix, ["player_id", "season", "week"]).select("player_id", "season", "week", R("points"))
