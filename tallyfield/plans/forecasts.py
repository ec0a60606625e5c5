"""Queries of forecasts, verdict, team effects, state hand-over and the read models of runs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tallyfield import views as v
from tallyfield.operators import asof, attribution, forecast, projection, statespace, status, teams
from tallyfield.plans.models import _BOOT, _FILTER, _SMOOTH, _STATES9, _rounded, AT, CELL, CELLS, DV, GRAM, MAY, TRIPLETS, back_sql, cells, gram_of_states, last_state, series, states, valued
from tallyfield.plans.relational import _POOL, _TOTALS, _VOR
from tallyfield.plans.relational import valued as valuations
from tallyfield.registry import query
from tallyfield.session import removed, written
from tallyfield.views import with_

R = lambda c, name=None: F.round(c, 7).alias(name or c)

# --- scoring, joins, unions --------------------------------------------------------------

_PROFILE = [("passing_yards", 0.04), ("passing_tds", 4.0), ("interceptions", -2.0), ("rushing_yards", 0.1), ("receptions", 1.0), ("receiving_yards", 0.1)]


@query(with_("player_stats", "SELECT player_id, season, week, CAST(4 * passing_yards + 400 * passing_tds - 200 * interceptions + 10 * rushing_yards + 100 * receptions + 10 * receiving_yards + 150 AS DOUBLE) / 100 AS points FROM player_stats"))
def f2_affine_points(spark, d):
    return v.player_stats(spark, d).select("player_id", "season", "week", forecast.affine_points(_PROFILE, 1.5).alias("points"))


@query(with_("player_stats", "SELECT position, count(*) AS n, CAST(sum(targets) AS BIGINT) AS targets FROM player_stats JOIN (SELECT DISTINCT player_id AS p FROM player_stats WHERE season = 2022) k ON player_id = p WHERE season = 2023 GROUP BY position"))
def j8_usage_positions(spark, d):
    """Usage of one season with the positions of the players known from the season before."""
    s = v.player_stats(spark, d)
    known = s.where("season = 2022").select("player_id", "position").distinct()
    return s.where("season = 2023").drop("position").join(F.broadcast(known), "player_id").groupBy("position").agg(F.count("*").alias("n"), F.sum("targets").alias("targets"))


@query(with_("history", "SELECT player_id, round(avg(points), 7) AS points_pg, count(*) AS games FROM history WHERE (season, week) < (2023, 7) GROUP BY player_id"))
def a15_draft_pool(spark, d):
    return v.history(spark, d).where(AT.outcome).groupBy("player_id").agg(R(F.avg("points"), "points_pg"), F.count("*").alias("games"))


@query(with_("history", f"SELECT season, count(*) AS n, round(sum(points), 6) AS points FROM history WHERE {MAY} GROUP BY season"))
def u2_prior_and_current(spark, d):
    """Seasons before and the current one to the cutoff, by one predicate instead of a union."""
    return v.history(spark, d).where(AT.outcome).groupBy("season").agg(F.count("*").alias("n"), F.round(F.sum("points"), 6).alias("points"))


@query(with_("history", "SELECT DISTINCT player_id, season, week FROM (SELECT player_id, 2023 AS season, 5 AS week FROM history WHERE position = 'QB' UNION ALL SELECT player_id, CAST(season AS INTEGER), CAST(week AS INTEGER) FROM history WHERE points > 40)"))
def u4_interventions(spark, d):
    """Interventions entered by hand and those found by a rule, each once."""
    h = v.history(spark, d)
    manual = h.where("position = 'QB'").select("player_id", F.lit(2023).alias("season"), F.lit(5).alias("week"))
    return manual.unionByName(h.where("points > 40").select("player_id", "season", "week")).distinct()


# --- bootstrap, baselines, verdict -------------------------------------------------------

_COUNT = " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in forecast._CUM)
_IID = """im AS (SELECT rep, sum(m * x) / sum(m) AS mean FROM (SELECT rep, x, CNT AS m FROM (SELECT rep, x, CAST('0x' || substr(md5('iid|' || rep || '|' || k), 1, 12) AS BIGINT) AS u FROM iu, range(200) r(rep))) GROUP BY rep),
ib AS (SELECT n, point, lower, upper, lower > 0 OR upper < 0 AS excludes_zero FROM (SELECT count(x) AS n, avg(x) AS point FROM iu), (SELECT quantile_cont(mean, 0.025) AS lower, quantile_cont(mean, 0.975) AS upper FROM im))""".replace("CNT", _COUNT)
_IU = "iu AS (SELECT player_id || '|' || week AS k, abs(baseline - actual) - abs(forecast - actual) AS x FROM c)"


@query(with_("history", "SELECT n, round(point, 7) AS point, round(lower, 7) AS lower, round(upper, 7) AS upper, excludes_zero FROM ib", CELL, _IU, _IID))
def e9_bootstrap(spark, d):
    """Interval of the mean margin, units drawn one by one."""
    u = cells(spark, d).withColumn("m", F.abs(F.col("baseline") - F.col("actual")) - F.abs(F.col("forecast") - F.col("actual")))
    return forecast.iid_bootstrap(u, "m", ["player_id", "week"]).select("n", R("point"), R("lower"), R("upper"), "excludes_zero")


@query(with_("history", """SELECT 'persistence' AS baseline, player_id, round(max_by(points, week), 7) AS forecast FROM history WHERE season = 2023 AND week < 7 GROUP BY player_id
UNION ALL SELECT 'season_to_date', player_id, round(avg(points), 7) FROM history WHERE season = 2023 AND week < 7 GROUP BY player_id
UNION ALL SELECT 'last_season', player_id, round(avg(points), 7) FROM history WHERE season = 2022 GROUP BY player_id"""))
def e20_default_baselines(spark, d):
    return forecast.default_baselines(v.history(spark, d), AT).select("baseline", "player_id", R("forecast"))


_MAP = f"""rt AS (SELECT player_id, position, avg(points) / 10 AS rating FROM history WHERE {MAY} GROUP BY ALL),
pm AS (SELECT h.position, regr_slope(points, rating) AS slope, regr_intercept(points, rating) AS intercept FROM history h JOIN rt USING (player_id) WHERE season = 2022 GROUP BY h.position HAVING count(*) >= 10 AND max(rating) > min(rating))"""


def past_ratings(spark, d):
    return v.history(spark, d).where(AT.outcome).groupBy("player_id", "position").agg((F.avg("points") / 10).alias("rating"))


def past_map(spark, d):
    """Points map from before the origin, made once for all origins after it."""
    h = v.history(spark, d).where("season = 2022").join(past_ratings(spark, d).drop("position"), "player_id")
    return projection.points_map(h)


@query(with_("history", "SELECT position, round(slope, 7) AS slope, round(intercept, 6) AS intercept FROM pm", _MAP))
def m26_frozen_points_map(spark, d):
    return past_map(spark, d).select("position", R("slope"), F.round("intercept", 6).alias("intercept"))


@query(with_("history", "SELECT 2023 AS season, 7 AS week, player_id, position, round(slope * rating + intercept, 6) AS forecast FROM rt JOIN pm USING (position)", _MAP))
def e14_weekly_forecast(spark, d):
    r = past_ratings(spark, d).withColumns({"season": F.lit(2023), "week": F.lit(7)})
    return forecast.weekly_points(r, past_map(spark, d)).select("season", "week", "player_id", "position", F.round("forecast", 6).alias("forecast"))


@query(with_("history", "SELECT player_id, position, round((slope * rating + intercept) * 12, 5) AS forecast, 12 AS games FROM rt JOIN pm USING (position)", _MAP))
def e15_rest_of_season(spark, d):
    """Points over the weeks left, from the frozen map."""
    r = past_ratings(spark, d).withColumns({"season": F.lit(2023), "week": F.lit(7)})
    pg = forecast.weekly_points(r, past_map(spark, d)).withColumnRenamed("forecast", "points_pg")
    return forecast.rest_of_season_points(pg, AT).select("player_id", "position", F.round("forecast", 5).alias("forecast"), "games")


_ROS = """ros AS (SELECT r.player_id, r.actual, l.baseline, (slope * rating + intercept) AS forecast FROM (SELECT player_id, avg(points) AS actual FROM history WHERE season = 2023 AND week >= 7 GROUP BY 1) r
 JOIN (SELECT player_id, avg(points) AS baseline FROM history WHERE season = 2022 GROUP BY 1) l USING (player_id) JOIN rt USING (player_id) JOIN pm USING (position)),
iu AS (SELECT player_id AS k, abs(baseline - actual) - abs(forecast - actual) AS x FROM ros)"""


def ros_margins(spark, d):
    h = v.history(spark, d)
    real = h.where("season = 2023 and week >= 7").groupBy("player_id").agg(F.avg("points").alias("actual"))
    last = asof.last_season(h, AT).select("player_id", F.col("forecast").alias("baseline"))
    r = past_ratings(spark, d).withColumns({"season": F.lit(2023), "week": F.lit(7)})
    f = forecast.weekly_points(r, past_map(spark, d)).select("player_id", "forecast")
    return real.join(last, "player_id").join(f, "player_id").withColumn("m", F.abs(F.col("baseline") - F.col("actual")) - F.abs(F.col("forecast") - F.col("actual")))


@query(with_("history", "SELECT CASE WHEN n = 0 THEN 'INCONCLUSIVE' WHEN point > 0 AND excludes_zero THEN 'SHIP' ELSE 'FALLBACK' END AS verdict, n, round(point, 6) AS point, round(lower, 6) AS lower, round(upper, 6) AS upper FROM ib", _MAP, _ROS, _IID))
def e19_verdict(spark, d):
    """Rest-of-season margin over last season's mean, its interval, and what follows."""
    m = forecast.decide(forecast.iid_bootstrap(ros_margins(spark, d), "m", ["player_id"]))
    return m.select("verdict", "n", *(F.round(c, 6).alias(c) for c in ("point", "lower", "upper")))


@query(with_("history", "SELECT week, count(*) AS n, round(avg(abs(baseline - actual) - abs(forecast - actual)), 7) AS margin FROM c GROUP BY week", CELL))
def e19_weekly_margins(spark, d):
    """The paired cells' margins that the weekly gate is drawn from."""
    return cells(spark, d).groupBy("week").agg(F.count("*").alias("n"), R(F.avg(F.abs(F.col("baseline") - F.col("actual")) - F.abs(F.col("forecast") - F.col("actual"))), "margin"))


@query(with_("history", "SELECT count(*) FILTER (week <> 3 OR season <> 2023) AS \"both\", count(*) FILTER (week = 3 AND season = 2023) AS left_only, 0::BIGINT AS right_only, count(*) FILTER (week = 4 AND season = 2023) AS apart_points FROM history"))
def e21_parity(spark, d):
    """A table against a copy that lacks one week and differs in another."""
    h = v.history(spark, d)
    other = h.where("not (season = 2023 and week = 3)").withColumn("points", F.when((F.col("season") == 2023) & (F.col("week") == 4), F.col("points") + 0.5).otherwise(F.col("points") * (1 + 1e-13)))
    return forecast.compare(h, other, ["player_id", "season", "week"], ["points"], absolute=1e-9, relative=1e-9)


_SIZES = {"QB": 5, "RB": 8, "WR": 8, "TE": 5}
_PB = """tp AS (SELECT *, row_number() OVER (PARTITION BY season, week, position ORDER BY points DESC, player_id) AS r FROM history WHERE season = 2022),
tt AS (SELECT * FROM tp WHERE r <= CASE position WHEN 'QB' THEN 5 WHEN 'TE' THEN 5 ELSE 8 END),
sc AS (SELECT position, avg(dv) AS scale FROM (SELECT position, abs(points - avg(points) OVER (PARTITION BY season, week, position)) AS dv FROM tt) GROUP BY position),
pe AS (SELECT position, avg(abs(forecast - actual)) AS e, avg(abs(baseline - actual)) AS b FROM c GROUP BY position)"""


@query(with_("history", "SELECT round(e, 7) AS engine, round(b, 7) AS baseline, round((b - e) / b, 7) AS improvement FROM (SELECT avg(e / scale) AS e, avg(b / scale) AS b FROM pe JOIN sc USING (position))", CELL, _PB))
def q5_balanced_mae(spark, d):
    """Position-balanced error; scales come from the season before the one that is judged."""
    scales = forecast.position_scales(v.history(spark, d).where("season = 2022"), _SIZES)
    return forecast.balanced_mae(cells(spark, d), scales).select(R("engine"), R("baseline"), R("improvement"))


@query(with_("history", "SELECT provider, n, round(mae, 7) AS mae, round(point, 7) AS point, round(lower, 7) AS lower, round(upper, 7) AS upper FROM (SELECT 'last_week' AS provider, avg(abs(baseline - actual)) AS mae FROM c), ib", CELL, _IU, _IID))
def qy10_benchmark_results(spark, d):
    """A provider's error, and the interval of the engine's margin over it; no raw rows."""
    c = cells(spark, d).withColumn("provider", F.lit("last_week")).withColumn("m", F.abs(F.col("baseline") - F.col("actual")) - F.abs(F.col("forecast") - F.col("actual")))
    e = c.groupBy("provider").agg(F.avg(F.abs(F.col("baseline") - F.col("actual"))).alias("mae"))
    b = forecast.iid_bootstrap(c, "m", ["player_id", "week"], by=["provider"])
    return e.join(b, "provider").select("provider", "n", R("mae"), R("point"), R("lower"), R("upper"))


# --- team effects, windows, credit -------------------------------------------------------

_RATED = "rated AS (SELECT player_id, position, (CAST(substr(player_id, 2) AS BIGINT) * 37 % 21 - 10) / 100.0::DOUBLE AS rating FROM players)"
_EXPO = """expo AS (SELECT side, team, player_id, m / n::DOUBLE AS share FROM (
 SELECT 'off' AS side, off_team AS team, player_id, count(*) AS m FROM (SELECT off_team, unnest(off_players) AS player_id FROM plays) GROUP BY ALL
 UNION ALL SELECT 'def', def_team, player_id, count(*) FROM (SELECT def_team, unnest(def_players) AS player_id FROM plays) GROUP BY ALL)
 JOIN (SELECT 'off' AS side, off_team AS team, count(*) AS n FROM plays GROUP BY ALL UNION ALL SELECT 'def', def_team, count(*) FROM plays GROUP BY ALL) USING (side, team))"""


def rated(spark, d):
    """Players with ratings that only depend on their number."""
    return v.players(spark, d).withColumn("rating", (F.substring("player_id", 2, 9).cast("long") * 37 % 21 - 10) / 100.0)


@query(with_("plays players", """SELECT team, round(o, 7) AS e_off, round(f, 7) AS e_def, round(o + f, 7) AS net, round(f, 7) AS grade FROM (
SELECT team, sum(CASE WHEN side = 'off' THEN share * coalesce(rating, 0) END) + CAST(team AS INTEGER) / 100.0::DOUBLE AS o, sum(CASE WHEN side = 'def' THEN share * coalesce(rating, 0) END) AS f FROM expo LEFT JOIN rated USING (player_id) GROUP BY team)""", _RATED, _EXPO))
def q2_team_effects(spark, d):
    p = v.plays(spark, d)
    own = p.select(F.lit("off").alias("side"), F.col("off_team").alias("team"), (F.col("off_team").cast("int") / 100.0).alias("value")).distinct()
    t = teams.team_effects(p, rated(spark, d), own)
    return t.select("team", *(R(c) for c in ("e_off", "e_def", "net", "grade")))


@query(with_("plays", "SELECT team, 'p:' || player_id AS col, round(sum(share), 7) AS val FROM expo GROUP BY ALL UNION ALL SELECT DISTINCT team, substr(side, 1, 1) || ':' || team, 1.0::DOUBLE FROM expo", _EXPO))
def q3_net_market_rows(spark, d):
    return teams.net_market_rows(v.plays(spark, d)).select("team", "col", R("val"))


@query(with_("states", "SELECT i, round(sum(v), 6) AS v, false AS research_only FROM gram WHERE j IS NULL AND season IN (1995, 1996) GROUP BY i", CELLS, DV, TRIPLETS, GRAM))
def q8_window_blocks(spark, d):
    """X'y of the two seasons before an in-season origin."""
    g = gram_of_states(spark, d)
    return teams.window_blocks(g.where("j is null"), 1997, 6).groupBy("i", "research_only").agg(F.round(F.sum("v"), 6).alias("v")).select("i", "v", "research_only")


_OPP = """opp AS (SELECT d.*, coalesce(ds.def_sum, 0) AS def_sum, bucket AS _cell, CAST('0x' || substr(md5(season || '|' || week), 1, 8) AS BIGINT) % 5 AS fold FROM (SELECT dv.*, B AS bucket FROM dv) d
 LEFT JOIN (SELECT drive_id, play_id, sum(coalesce(rating, 0)) AS def_sum FROM (SELECT drive_id, play_id, unnest(def_players) AS player_id FROM plays) LEFT JOIN rated USING (player_id) GROUP BY ALL) ds USING (drive_id, play_id)),
pt AS (SELECT _cell, fold, count(*) AS n, sum(def_sum) AS sx, sum(dv) AS sy, sum(def_sum * def_sum) AS sxx, sum(def_sum * dv) AS sxy FROM opp GROUP BY ALL),
wh AS (SELECT _cell, sum(n) AS tn, sum(sx) AS tx, sum(sy) AS ty, sum(sxx) AS txx, sum(sxy) AS txy FROM pt GROUP BY _cell),
lo AS (SELECT _cell, fold, tn - n AS n, tx - sx AS x, ty - sy AS y, txx - sxx AS xx, txy - sxy AS xy FROM pt JOIN wh USING (_cell)),
res AS (SELECT o.*, dv - CASE WHEN l.n > 0 THEN l.y / l.n ELSE 0 END - CASE WHEN l.n > 1 THEN (xy - l.x * l.y / l.n) / (xx - l.x * l.x / l.n + 1.0) ELSE 0 END * (def_sum - CASE WHEN l.n > 0 THEN l.x / l.n ELSE 0 END) AS resid
 FROM opp o JOIN lo l USING (_cell, fold))"""


def _bucket_sql() -> str:
    from tallyfield.plans.models import BUCKET

    return BUCKET("")


def residuals(spark, d):
    p = attribution.with_def_sum(valued(spark, d), rated(spark, d))
    p = p.withColumn("_cell", attribution.state_bucket(*(F.col(c) for c in attribution.STATE))).withColumn("fold", attribution.fold_of(F.col("season"), F.col("week")))
    return teams.opponent_residual(p, "_cell", "fold")


@query(with_("states players", "SELECT drive_id, play_id, round(resid, 6) AS resid FROM res", CELLS, DV, _RATED, _OPP.replace("B AS bucket", f"{_bucket_sql()} AS bucket")))
def m10_opponent_residual(spark, d):
    """Play value less what the state and the defenders' ratings explain."""
    return residuals(spark, d).select("drive_id", "play_id", F.round("resid", 6).alias("resid"))


@query(with_("states players", """SELECT player_id, season, week, round(avg(resid), 6) AS credit, count(*) AS snaps FROM (SELECT season, week, resid, unnest(off_players) AS player_id FROM res) JOIN (SELECT player_id FROM players WHERE position = 'QB') USING (player_id)
WHERE player_id IN (SELECT player_id FROM (SELECT unnest(off_players) AS player_id FROM plays) GROUP BY 1 HAVING count(*) >= 20) GROUP BY ALL""", CELLS, DV, _RATED, _OPP.replace("B AS bucket", f"{_bucket_sql()} AS bucket")))
def a8_all_quarterbacks(spark, d):
    return teams.qb_credit(residuals(spark, d), v.players(spark, d)).select("player_id", "season", "week", F.round("credit", 6).alias("credit"), "snaps")


@query()
def m11_fixed_point(spark, d):
    """Ratings and the focus quarterback's credit after three rounds; Gram sums are made once."""
    who = v.players(spark, d)
    plays, at = written(valued(spark, d))
    g = attribution.play_gram(plays, who, [])
    sums = {(r.i, r.j): r.v for r in g.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    focus = "p0"
    base = plays.withColumn("_cell", attribution.state_bucket(*(F.col(c) for c in attribution.STATE))).withColumn("fold", attribution.fold_of(F.col("season"), F.col("week")))

    def credit(beta: dict[str, float]) -> float:
        r = spark.createDataFrame([(k[2:], b) for k, b in beta.items() if k.startswith("p:")], "player_id string, rating double")
        j = attribution.with_def_sum(base, r)
        mine = teams.opponent_residual(j, "_cell", "fold").where(F.array_contains("off_players", focus))
        weeks = mine.groupBy("season", "week").agg(F.avg("resid").alias("c"))
        return weeks.agg(F.coalesce(F.avg("c"), F.lit(0.0))).first()[0]

    ratings, credits = teams.fixed_point(lambda prior: attribution.solve_system(sums, prior={f"p:{k}": x for k, x in prior.items()}), credit, focus)
    removed(spark, at)
    return spark.createDataFrame([(k, b, credits[-1] if k == f"p:{focus}" else None) for k, b in sorted(ratings.items())], "col string, rating double, credit double")


# --- state -------------------------------------------------------------------------------


@query("WITH RECURSIVE " + with_("history", "SELECT r.player_id, o.season, o.week, round(x0, 5) AS talent, round(x1, 5) AS form, round(x0 + x1 + x2, 5) AS total, round(var, 5) AS var FROM run r JOIN par o USING (player_id, k) WHERE o.season = 2023 AND o.week IN (5, 6)", _FILTER)[5:])
def k6_trajectory(spark, d):
    """Two weeks of filtered states entered one after the other, the second one twice."""
    f = statespace.filtered(series(spark, d))
    t = f.select("player_id", "season", "week", F.col("x0").alias("talent"), F.col("x1").alias("form"), (F.col("x0") + F.col("x1") + F.col("x2")).alias("total"), "var")
    week = lambda w: t.where(f"season = 2023 and week = {w}")
    keys = ["player_id", "season", "week"]
    out = asof.merge_rows(asof.merge_rows(week(5), week(6), keys), week(6), keys)
    return out.select(*keys, *(F.round(c, 5).alias(c) for c in ("talent", "form", "total", "var")))


@query(with_("player_stats", "SELECT player_id, format, CASE WHEN format = 'Half PPR' THEN round(vor, 7) ELSE -1 END AS vor, CASE WHEN format = 'Half PPR' THEN rank ELSE 0 END AS rank FROM ranked", _TOTALS, _POOL, _VOR))
def k7_upsert_valuations(spark, d):
    """Values of one format replace its old ones; the other formats stay."""
    new = valuations(spark, d).select("player_id", "format", "vor", F.col("rank").cast("int").alias("rank"))
    old = new.withColumn("vor", F.lit(-1.0)).withColumn("rank", F.lit(0))
    return asof.merge_rows(old, new.where("format = 'Half PPR'"), ["player_id", "format"]).select("player_id", "format", R("vor"), "rank")


def _content(rules: dict[str, float]) -> str:
    return hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()[:16]


@query("SELECT DISTINCT c_mktsegment AS name, 'custom' AS content FROM customer UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{_content(r)}')" for n, r in v.PROFILES.items()) + ") t(name, content)")
def k9_preset_formats(spark, d):
    """Presets are entered by name over what a stale one said; the customers' formats stay."""
    own = v.read(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("custom").alias("content")).distinct()
    old = own.unionByName(spark.createDataFrame([("Full PPR", "stale")], "name string, content string"))
    new = spark.createDataFrame([(n, _content(r)) for n, r in v.PROFILES.items()], "name string, content string")
    return asof.merge_rows(asof.merge_rows(old, new, ["name"]), new, ["name"])


@query("WITH RECURSIVE " + with_("history", f"""SELECT c_id AS player_id, CASE WHEN l.player_id IS NULL THEN 0.0 ELSE round(x0, 5) END AS x0, CASE WHEN l.player_id IS NULL THEN 0.05 ELSE round(p00, 5) END AS p00 FROM
(SELECT 'u' || c_custkey AS c_id FROM customer) LEFT JOIN (SELECT r.* FROM run r JOIN par o USING (player_id, k) WHERE {MAY} QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY o.season DESC, o.week DESC) = 1) l ON l.player_id = c_id""", _FILTER)[5:])
def j12_roster_remap(spark, d):
    """The filter's state for a new roster: known players keep theirs, others start."""
    roster = v.read(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("player_id"))
    start = {"x0": 0.0, "p00": statespace.START_VAR[0]}
    got = teams.remap_state(last_state(spark, d).select("player_id", "x0", "p00"), roster, start)
    return got.select("player_id", F.round("x0", 5).alias("x0"), F.round("p00", 5).alias("p00"))


@query()
def m25_frozen_talent(spark, d):
    """Smoothed talent at the last week before the origin, of data from before it alone."""
    s = statespace.smoothed(series(spark, d).where(AT.outcome))
    return s.groupBy("player_id").agg(F.max_by("talent", F.struct("season", "week")).alias("talent"))


@query("WITH RECURSIVE " + with_("history", f"SELECT b.player_id, o.season, o.week, {_SMOOTH} FROM back b JOIN par o USING (player_id, k) WHERE b.k = b.t", _FILTER,
       back_sql("back", f"SELECT {_STATES9}, a.player_id, a.k, t.k AS t FROM run a JOIN (SELECT player_id, k, max(k) OVER (PARTITION BY player_id) AS n FROM run WHERE k > 0) t ON a.player_id = t.player_id AND a.k = least(t.k + 2, n)", ", t", "b.k > b.t"))[5:])
def q9_fixed_lag(spark, d):
    """Talent of each week from data up to two weeks later, over all seasons."""
    return _rounded(statespace.fixed_lag(series(spark, d), 2))


# --- read models of the store ------------------------------------------------------------

_THRESHOLDS = [("click", 5), ("view", 2), ("purchase", 60), ("error", 30), ("refund", 10)]
_NOW = "2024-01-31 00:00:00"


@query(with_("runs", f"""SELECT source, published, coalesce(age, -1) AS age_seconds, CASE WHEN published IS NULL THEN 'Missing' WHEN age > minutes * 60 THEN 'Stale' ELSE 'Fresh' END AS state FROM (
SELECT source, minutes, published, CAST(floor(epoch(TIMESTAMP '{_NOW}')) - floor(epoch(published)) AS BIGINT) AS age FROM (VALUES {', '.join(f"('{n}', {m})" for n, m in _THRESHOLDS)}) t(source, minutes)
LEFT JOIN (SELECT source, max(finished_at) AS published FROM runs WHERE state = 'done' GROUP BY source) USING (source))"""))
def qy5_freshness(spark, d):
    """Age of each source's last publication against its threshold."""
    return status.freshness(v.runs(spark, d), spark.createDataFrame(_THRESHOLDS, "source string, minutes int"), _NOW)


@query(with_("runs", "SELECT source, run_id, state, finished_at, failed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY finished_at DESC, run_id DESC) AS r, count(*) FILTER (state = 'failed') OVER (PARTITION BY source) AS failed FROM runs WHERE state <> 'running') WHERE r = 1"))
def qy6_ingestion_status(spark, d):
    return status.last_runs(v.runs(spark, d))


@query(with_("runs", "SELECT source, count(*) AS n, min(started_at) AS since, arg_min(run_id, (started_at, run_id)) AS first_run FROM runs WHERE state = 'running' GROUP BY source"))
def qy7_running_jobs(spark, d):
    return status.running(v.runs(spark, d))


@query(with_("links", "SELECT tier, provider_id, player_id, confidence FROM links WHERE state = 'pending' ORDER BY tier, confidence DESC, provider_id LIMIT 25 OFFSET 25"))
def qy8_review_queue(spark, d):
    """The second page of the queue."""
    return status.review_queue(v.links(spark, d), 25, 25)


@query(with_("models", "SELECT family, count(*) AS versions, max(CASE WHEN role = 'champion' THEN version END) AS production, arg_max(version, created) AS newest, max(validated) AS last_validation FROM models GROUP BY family"))
def qy14_model_status(spark, d):
    return status.model_status(v.models(spark, d))
