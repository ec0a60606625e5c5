"""Queries over solved systems: the distributed solver, interactions, boosted residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield import views as v
from tallyfield.functions.normal import ppf
from tallyfield.operators import asof, attribution, evaluation, forecast, guards, solver, teams, verdict
from tallyfield.operators.asof import AsOf, LeakageError
from tallyfield.plans.forecasts import _PB, _SIZES
from tallyfield.plans.models import CELLS, DV, GRAM, TRIPLETS, gram_of_states, states, system, valued
from tallyfield.registry import query
from tallyfield.session import removed, scratch, written
from tallyfield.sources import snapshots
from tallyfield.views import with_


def position_scale(players):
    return players.select(F.concat(F.lit("p:"), "player_id").alias("col"), F.when(F.col("position") == "DEF", 2.0).otherwise(1.0).alias("factor"))


@query()
def q10_cg_ratings(spark, d):
    """Ratings of m6 by conjugate gradients over the entries, with no dense matrix."""
    return solver.conjugate_gradient(system(spark, d), scale=position_scale(v.players(spark, d))).ratings


_MARKET = """market AS (SELECT off_team AS team, avg(drive_points) / 10 AS s FROM plays GROUP BY 1)"""


@query(with_("states", "SELECT col, round(sum(b), 4) AS b FROM (SELECT i AS col, v AS b FROM gram WHERE j IS NULL UNION ALL SELECT unnest(['o:' || team, 'd:' || team]), 40 * s FROM market) GROUP BY col", CELLS, DV, TRIPLETS, GRAM, _MARKET))
def q10_normal_equations(spark, d):
    """The solution put back: A times the ratings must be X'y, which SQL can say."""
    g, _ = written(system(spark, d))  # read twice
    scale = position_scale(v.players(spark, d))
    x = solver.conjugate_gradient(g, scale=scale, tol=1e-12).ratings
    a = g.where("j is not null")
    a = a.unionByName(a.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    made = a.join(x.withColumnRenamed("col", "j"), "j").select(F.col("i").alias("col"), (F.col("v") * F.col("rating")).alias("b"))
    pen = x.join(scale, "col", "left").select("col", (120.0 * F.coalesce("factor", solver.penalty_factor(F.col("col"))) * F.col("rating")).alias("b"))
    return made.unionByName(pen).groupBy("col").agg(F.round(F.sum("b"), 4).alias("b"))


@query(with_("states", "SELECT i, j, round(sum(v), 7) AS v FROM gram WHERE season < 1997 OR (season = 1997 AND week <= 5) GROUP BY i, j", CELLS, DV, TRIPLETS, GRAM))
def e13_origin_system(spark, d):
    """Whole X'X and X'y at an origin, from the blocks of earlier slots."""
    g = gram_of_states(spark, d)
    return g.where(AsOf(1997, 6).outcome).groupBy("i", "j").agg(F.round(F.sum("v"), 7).alias("v"))


def rated(spark, d):
    """Every player's rating from the whole log (player_id, rating)."""
    x = solver.ridge_ratings(system(spark, d), scale=position_scale(v.players(spark, d)))
    return x.where("col like 'p:%'").select(F.substring("col", 3, 100).alias("player_id"), "rating")


@query()
def m10_boosted_residual(spark, d):
    """Play value less a boosted surface of state and defenders' ratings, five folds of weeks."""
    r = attribution.boosted_residual(valued(spark, d), rated(spark, d))
    return r.select("drive_id", "play_id", "fold", F.round("resid", 8).alias("resid"))


@query()
def a7_boosted_credit(spark, d):
    """Weekly credit of every player with 20 plays or more from the boosted residual."""
    r = attribution.boosted_residual(valued(spark, d), rated(spark, d))
    return attribution.weekly_credit(r).select("player_id", "season", "week", F.round("credit", 8).alias("credit"), "snaps")


def boosted_fixed_point(valued_plays, gram, scale, focus: str, rounds: int = 3, boosts: int = 200):
    """Ratings, and the focus player's credit in each round, by coordinate ascent: ratings from
    the sums with market rows and penalties by position, credit from the boosted residual with
    those ratings on the field, and the credit as the player's prior mean of the next round."""
    spark = valued_plays.sparkSession
    plays, plays_at = written(valued_plays)
    sums, sums_at = written(gram)

    def solve(prior: dict[str, float]):
        mean = spark.createDataFrame([(f"p:{k}", x) for k, x in prior.items()], "col string, mean double")
        return solver.ridge_ratings(sums, prior=mean, scale=scale)

    def credit(x) -> float:
        who = x.where("col like 'p:%'").select(F.substring("col", 3, 100).alias("player_id"), "rating")
        weeks = attribution.boosted_residual(plays, who, rounds=boosts).where(F.array_contains("off_players", focus)).groupBy("season", "week").agg(F.avg("resid").alias("c"))
        return weeks.agg(F.coalesce(F.avg("c"), F.lit(0.0))).first()[0]

    ratings, credits = teams.fixed_point(solve, credit, focus, rounds)
    for at in (plays_at, sums_at):
        removed(spark, at)
    return ratings, credits


@query()
def m11_boosted_fixed_point(spark, d):
    """Three rounds for one quarterback; ``credit`` is that of the last round."""
    who = v.players(spark, d)
    ratings, credits = boosted_fixed_point(valued(spark, d), system(spark, d), position_scale(who), "p0")
    return ratings.join(who.select(F.concat(F.lit("p:"), "player_id").alias("col"), "position"), "col", "left").select(
        "col", F.coalesce("position", F.lit("TEAM")).alias("position"), F.round("rating", 9).alias("rating"), F.when(F.col("col") == "p:p0", F.lit(round(credits[-1], 9))).alias("credit")
    )


_PAIRS = """meet AS (SELECT drive_id, play_id, a.player_id AS a, b.player_id AS b, count(*) AS n FROM
 (SELECT drive_id, play_id, player_id FROM (SELECT drive_id, play_id, unnest(off_players) AS player_id FROM plays) JOIN players USING (player_id) WHERE position = 'WR') a JOIN
 (SELECT drive_id, play_id, player_id FROM (SELECT drive_id, play_id, unnest(def_players) AS player_id FROM plays) JOIN players USING (player_id) WHERE position = 'DEF') b USING (drive_id, play_id) GROUP BY ALL),
tri2 AS (SELECT drive_id, play_id, col, val FROM tri UNION ALL SELECT drive_id, play_id, 'x:' || a || '|' || b, n FROM meet WHERE (a, b) IN (SELECT (a, b) FROM meet GROUP BY a, b HAVING sum(n) >= 30)),
gram2 AS (SELECT a.col AS i, b.col AS j, sum(a.val * b.val) AS v FROM tri2 a JOIN tri2 b USING (drive_id, play_id) WHERE a.col <= b.col GROUP BY ALL
  UNION ALL SELECT t.col, NULL, sum(t.val * d.dv) FROM tri2 t JOIN dv d USING (drive_id, play_id) GROUP BY ALL)"""


@query(with_("states players", "SELECT i, j, round(v, 7) AS v FROM gram2", CELLS, DV, TRIPLETS, _PAIRS))
def m4_interaction_gram(spark, d):
    """Gram sums with a column for each receiver and defender that met on 30 plays or more."""
    g = attribution.play_gram(valued(spark, d), v.players(spark, d), [], interactions=30, plays=v.plays(spark, d))
    return g.select("i", "j", F.round("v", 7).alias("v"))


@query()
def m4_interaction_ratings(spark, d):
    """Ratings of players, teams and pairs; pairs have ten times a player's penalty."""
    g = attribution.play_gram(valued(spark, d), v.players(spark, d), [], interactions=30, plays=v.plays(spark, d))
    return solver.ridge_ratings(g).select("col", F.round("rating", 9).alias("rating"))


def play_points(spark, d):
    """Realised points of the plays' own players: a tenth of the yards on the field, six for
    being there at a touchdown."""
    s = states(spark, d).select("season", "week", F.explode(F.array_distinct("off_players")).alias("player_id"), (F.col("yards") / 10 + F.when(F.col("terminal") & (F.col("drive_points") == 7), 6).otherwise(0)).alias("p"))
    return s.groupBy("player_id", "season", "week").agg(F.sum("p").alias("points"))


def origin_ratings(spark, d):
    """Players' ratings at every origin (season, week, player_id, rating)."""
    x, _ = written(evaluation.walk_forward_ratings(states(spark, d), v.players(spark, d)))
    return x.where("col like 'p:%'").select("season", "week", F.substring("col", 3, 100).alias("player_id"), "rating")


@query()
def e19_fitted_verdict(spark, d):
    """Ratings solved at every origin, forecasts by the frozen map, three baselines, two
    horizons, 10,000 week-clustered draws, noise floors and the verdict."""
    history, _ = written(play_points(spark, d))
    return verdict.run_verdict(origin_ratings(spark, d), history, v.players(spark, d))


@query()
def e14_fitted_forecasts(spark, d):
    """Weekly forecasts of all origins from solved ratings."""
    r, who = origin_ratings(spark, d), v.players(spark, d)
    f = forecast.weekly_points(r.join(who.select("player_id", "position"), "player_id"), verdict.frozen_map(r, play_points(spark, d), who))
    return f.select("season", "week", "player_id", "position", F.round("forecast", 6).alias("forecast"))


@query()
def qy12_fitted_ratings(spark, d):
    """A player's rating with its metadata, last weekly credit, the net strength of its team and
    the grade of its team's defence."""
    who = v.players(spark, d)
    x = solver.ridge_ratings(system(spark, d), scale=position_scale(who))
    x, _ = written(x)
    mine = x.where("col like 'p:%'").select(F.substring("col", 3, 100).alias("player_id"), "rating")
    side = lambda p, name: x.where(F.col("col").startswith(p)).select(F.substring("col", 3, 100).alias("team"), F.col("rating").alias(name))
    team = side("o:", "_o").join(side("d:", "_d"), "team").select("team", (F.col("_o") - F.col("_d")).alias("net_strength"), (-F.col("_d")).alias("defence_grade"))
    credit = attribution.weekly_credit(attribution.context_residual(valued(spark, d)))
    last = credit.groupBy("player_id").agg(F.max_by(F.struct("credit", "snaps"), F.struct("season", "week")).alias("l"), F.avg("credit").alias("mean_credit"))
    j = who.join(mine, "player_id").join(team, "team", "left").join(last, "player_id", "left")
    return j.select("player_id", "position", "team", F.round("rating", 9).alias("rating"), F.round("l.credit", 9).alias("last_credit"), F.col("l.snaps").alias("last_snaps"), F.round("mean_credit", 9).alias("mean_credit"), F.round("net_strength", 9).alias("net_strength"), F.round("defence_grade", 9).alias("defence_grade"))


@query(with_("raw", "SELECT season, count(*) AS n, sum(yards) AS yards, count(DISTINCT drive_id) AS drives FROM raw WHERE season IN (1996, 1998) GROUP BY season"))
def s8_snapshot_scan(spark, d):
    """The raw log as a snapshot by season, checked, and two of its seasons scanned."""
    at = scratch(spark)
    snapshots.write(v.raw_pbp(spark, d).withColumn("yards", F.col("yards").cast("int")), f"{at}/plays")
    s = snapshots.source(spark, at, "plays", [1996, 1998])
    return s.groupBy("season").agg(F.count("*").alias("n"), F.sum("yards").alias("yards"), F.count_distinct("drive_id").alias("drives"))


@query(with_("history", "SELECT 'u' AS kind, count(*) FILTER (season > 2023 OR (season = 2023 AND week >= 7)) AS future_rows, true AS persistence_is_blind, true AS season_mean_is_blind, true AS fitted_on_all_is_caught FROM history"))
def q11_future_guards(spark, d):
    """Two baselines keep still when the future is poisoned; one fitted on everything doesn't."""
    h, _ = written(v.history(spark, d))
    at = AsOf(2023, 7)

    def blind(f) -> bool:
        try:
            guards.future_poisoning(f, {"history": h}, at, {"history": ["points"]})
            return True
        except LeakageError:
            return False

    late = h.where(~at.outcome).agg(F.count("*").alias("future_rows"))
    everything = lambda s, a: s["history"].groupBy("player_id").agg(F.avg("points").alias("forecast"))
    say = {"persistence_is_blind": blind(lambda s, a: asof.persistence(s["history"], a)), "season_mean_is_blind": blind(lambda s, a: asof.season_to_date(s["history"], a)), "fitted_on_all_is_caught": not blind(everything)}
    return late.select(F.lit("u").alias("kind"), "future_rows", *(F.lit(x).alias(k) for k, x in say.items()))


_CARD = f"""sl AS (SELECT DISTINCT season, week FROM history), f AS (SELECT player_id, any_value(position) AS position, avg(points) AS forecast, stddev_samp(points) AS sd, count(DISTINCT week)::DOUBLE / (SELECT count(*) FROM sl WHERE season = 2022) AS p_active FROM history WHERE season = 2022 GROUP BY player_id),
g AS (SELECT f.*, s.week, h.points AS actual FROM f CROSS JOIN (SELECT week FROM sl WHERE season = 2023) s LEFT JOIN history h ON h.player_id = f.player_id AND h.season = 2023 AND h.week = s.week WHERE f.sd > 0),
rk2 AS (SELECT week, position, (1 + coalesce(corr(rp, ra), 0)) / 2 AS rk, count(*) AS k FROM (SELECT *, rank() OVER (PARTITION BY week, position ORDER BY forecast) + (count(*) OVER (PARTITION BY week, position, forecast) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY week, position ORDER BY actual) + (count(*) OVER (PARTITION BY week, position, actual) - 1) / 2.0 AS ra
 FROM (SELECT * REPLACE (round(forecast, 6) AS forecast) FROM g WHERE actual IS NOT NULL)) GROUP BY ALL),
b AS (SELECT g.week, g.position, count(*) AS n, count(actual) AS m, sum(abs(forecast - actual)) AS ae, sum(pow(forecast - actual, 2)) AS se, sum(pow(p_active - CASE WHEN actual IS NULL THEN 0 ELSE 1 END, 2)) AS br,
  sum(CASE WHEN abs(forecast - actual) <= {ppf(0.9)!r}::DOUBLE * sd THEN 1 ELSE 0 END) FILTER (actual IS NOT NULL) AS cov, any_value(CASE WHEN k >= 2 THEN rk END) AS rk FROM g LEFT JOIN rk2 USING (week, position) GROUP BY g.week, g.position),
q AS (SELECT week, position, sum(ae) / sum(m) / any_value(scale) AS x, 1 AS lv FROM b JOIN sc USING (position) GROUP BY week, position UNION ALL SELECT NULL, position, sum(ae) / sum(m) / any_value(scale), 2 FROM b JOIN sc USING (position) GROUP BY position)"""


@query(with_("history", """SELECT r.week, r.position, n, round(pb, 7) AS pb_mae, round(ae / m, 7) AS mae, round(sqrt(se / m), 7) AS rmse, round(rk, 7) AS rank_accuracy, round(br / n, 7) AS brier_active, round(cov::DOUBLE / m, 7) AS interval_coverage FROM (
 SELECT CASE WHEN grouping(week) = 0 THEN week END AS week, CASE WHEN grouping(position) = 0 THEN position END AS position, grouping(week) AS gw, CAST(sum(n) AS BIGINT) AS n, sum(m) AS m, sum(ae) AS ae, sum(se) AS se, sum(br) AS br, sum(cov) AS cov, avg(rk) AS rk
 FROM b GROUP BY GROUPING SETS ((week, position), (week), (position), ())) r JOIN (
 SELECT week, position, x AS pb FROM q UNION ALL SELECT week, NULL, avg(x) FROM q WHERE lv = 1 GROUP BY week UNION ALL SELECT NULL, NULL, avg(x) FROM q WHERE lv = 2) p ON r.week IS NOT DISTINCT FROM p.week AND r.position IS NOT DISTINCT FROM p.position""", _PB, _CARD))
def qy9_full_scorecard(spark, d):
    """Position-balanced and plain errors, rank accuracy, Brier score of being active and coverage
    of the 80 % interval, of last season's mean as the forecast."""
    h = v.history(spark, d)
    slots = h.where("season = 2022").agg(F.count_distinct("week").alias("_w"))
    f = h.where("season = 2022").groupBy("player_id").agg(F.first("position").alias("position"), F.avg("points").alias("forecast"), F.stddev_samp("points").alias("sd"), F.count_distinct("week").alias("_k"))
    f = f.where("sd > 0").crossJoin(F.broadcast(slots)).withColumn("p_active", F.col("_k") / F.col("_w"))  # one row
    weeks = h.where("season = 2023").agg(F.sort_array(F.collect_set("week")).alias("_weeks"))
    grid = f.crossJoin(F.broadcast(weeks)).withColumn("week", F.explode("_weeks"))  # one row, a season's weeks
    real = h.where("season = 2023").select("player_id", "week", F.col("points").alias("actual"))
    cells = grid.join(real, ["player_id", "week"], "left")
    card = evaluation.scorecard(cells, forecast.position_scales(h.where("season = 2022"), _SIZES))
    return card.select("week", "position", "n", *(F.round(c, 7).alias(c) for c in ("pb_mae", "mae", "rmse", "rank_accuracy", "brier_active", "interval_coverage")))
