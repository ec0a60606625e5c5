"""Priors, volume, rates and point maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.asof import AsOf

# Fixed values.
PRIOR_SD = {"QB": 0.16, "RB": 0.07, "WR": 0.08, "TE": 0.06, "DEF": 0.07}
OTHER_SD = 0.10
LEAGUE_FACTOR = {"FBS": 0.35, "FCS": 0.20, "UFL": 0.15, "USFL": 0.15, "XFL": 0.15, "CFL": 0.18, "unknown": 0.25}
VOLUME = ["pass_attempts", "rush_attempts", "targets"]
RATES = {
    "pass_attempts": ["completions", "passing_yards", "passing_tds", "interceptions"],
    "rush_attempts": ["rushing_yards", "rushing_tds", "fumbles_lost"],
    "targets": ["receptions", "receiving_yards", "receiving_tds"],
}
FEATURES = ["rapm_rating", "smoothed_talent", "prior_mean"]


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in values.items()), F.lit(default))


def age_step(age: Column) -> Column:
    return F.when(age < 24, 0.05).when(age > 30, -0.05).otherwise(0.0)


def draft_step(r: Column) -> Column:
    return F.when(r.isNull(), 0.0).when(r == 0, -0.03).when(r == 1, 0.08).when(r <= 3, 0.03).otherwise(0.0)


def equivalency(feeder: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row: slope and intercept of rating on feeder value over shared non-rookies, and
    R2 on the 30 % whose hash holds them out of a second fit."""
    s = feeder.where(~F.col("is_rookie")).join(ratings.select("player_id", "rating"), "player_id")
    s = s.withColumn("_out", F.conv(F.substring(F.md5("player_id"), 1, 4), 16, 10).cast("long") % 10 >= 7)
    fit = F.struct(F.regr_slope("rating", "feeder_sv").alias("slope"), F.regr_intercept("rating", "feeder_sv").alias("intercept"))
    whole = s.agg(fit.alias("f"), F.count("*").alias("n_shared"))
    part = s.where(~F.col("_out")).agg(fit.alias("t"))
    mean = s.where("_out").agg(F.avg("rating").alias("m"))
    test = s.where("_out").crossJoin(F.broadcast(part)).crossJoin(F.broadcast(mean))  # one row each
    r2 = test.agg((1 - F.sum(F.pow(F.col("rating") - F.col("t.intercept") - F.col("t.slope") * F.col("feeder_sv"), 2)) / F.sum(F.pow(F.col("rating") - F.col("m"), 2))).alias("oos_r2"))
    return whole.crossJoin(F.broadcast(r2)).select("f.slope", "f.intercept", "oos_r2", "n_shared")


def priors(feeder: DataFrame, slope: float, intercept: float, age: str | None = None, draft: str | None = None) -> DataFrame:
    mean = intercept + slope * F.col("feeder_sv")
    if age in feeder.columns:
        mean = mean + age_step(F.col(age))
    if draft in feeder.columns:
        mean = mean + draft_step(F.col(draft))
    sd = lookup(F.col("position"), PRIOR_SD, OTHER_SD)
    return feeder.select("player_id", "position", "is_rookie", "feeder_sv", mean.alias("prior_mean"), (sd * sd).alias("prior_var"), sd.alias("prior_sd"))


def washout(noise: DataFrame, games: tuple[int, ...] = (1, 2, 4, 6, 8, 12)) -> DataFrame:
    """Weight of the prior after so many games, a row per position of ``noise`` (position,
    obs_var a game) and number of games."""
    df = noise.withColumn("prior_sd", lookup(F.col("position"), PRIOR_SD, OTHER_SD)).select("*", F.explode(F.array(*map(F.lit, games))).alias("games"))
    inverse = 1 / (F.col("prior_sd") * F.col("prior_sd"))
    return df.withColumn("weight", inverse / (inverse + F.col("games") / F.col("obs_var")))


def volume(stats: DataFrame, at: AsOf, k: float = 8.0, overrides: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Usage a game: the last prior season's, shrunk to the position's mean by games played."""
    known = stats.where(at.outcome)
    agg = known.groupBy("player_id", "position", "season").agg(F.count_distinct("week").alias("games"), *(F.sum(c).alias(c) for c in VOLUME))
    agg = agg.where(F.col("season") < at.season).withColumns({f"{c}_pg": F.col(c) / F.col("games") for c in VOLUME})
    last = agg.groupBy("player_id").agg(F.max_by(F.struct("position", "games", *(f"{c}_pg" for c in VOLUME)), "season").alias("r")).select("player_id", "r.*")
    mean = last.groupBy("position").agg(*(F.avg(f"{c}_pg").alias(f"{c}_mean") for c in VOLUME))
    w = F.col("games") / (F.col("games") + k)
    out = last.join(mean, "position").select("player_id", "position", "games", *((w * F.col(f"{c}_pg") + (1 - w) * F.col(f"{c}_mean")).alias(c) for c in VOLUME))
    for player, values in (overrides or {}).items():
        if unknown := set(values) - set(VOLUME):
            raise ValueError(f"unknown volume columns for {player}: {sorted(unknown)}")
        out = out.withColumns({c: F.when(F.col("player_id") == player, F.lit(float(v))).otherwise(F.col(c)) for c, v in values.items()})
    return out


class DegeneratePool(ValueError):
    """Players of a position don't differ in a driver by more than chance."""


def volume_pools(usage: DataFrame, drivers: list[str] = VOLUME) -> DataFrame:
    """Gamma-Poisson pools (position, driver, n, mean, between, k) of players' usage.

    ``usage`` has player_id, position, games (exposure) and the drivers' totals over them.
    Four sums a pool: players, exposure, events, and squared events over exposure. ``k`` is the
    prior's weight in games, by moments; null where players differ by no more than chance.
    """
    pairs = F.array(*(F.struct(F.lit(d).alias("driver"), F.coalesce(F.col(d), F.lit(0)).cast("double").alias("y")) for d in drivers))
    long = usage.where(F.col("games") > 0).select("position", F.col("games").cast("double").alias("g"), F.explode(pairs).alias("e")).select("position", "g", "e.driver", "e.y")
    sums = long.groupBy("position", "driver").agg(F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y") / F.col("g")).alias("q"))
    mean = F.col("y") / F.col("g")
    between = (F.col("q") - F.col("y") * F.col("y") / F.col("g")) / F.col("g") - mean * F.col("n") / F.col("g")
    pools = sums.select("position", "driver", "n", mean.alias("mean"), between.alias("between"))
    return pools.withColumn("k", F.when(F.col("between") > 0, F.col("mean") / F.col("between")))


def expected_volume(usage: DataFrame, pools: DataFrame, drivers: list[str] = VOLUME, degenerate: str = "raise") -> DataFrame:
    """Usage a game of every player with exposure: the pool's mean and the player's own, weighted
    by k and by games.

    A pool without k is a ``DegeneratePool``; with ``degenerate="mean"`` its players take the
    pool's mean instead. Pools are a row a position and driver.
    """
    if degenerate not in ("raise", "mean"):
        raise ValueError(f"degenerate={degenerate}")
    if degenerate == "raise" and (bad := pools.where("k is null").limit(1).collect()):
        raise DegeneratePool(f"{bad[0].driver} of {bad[0].position}")
    wide = pools.groupBy("position").agg(*(F.max(F.when(F.col("driver") == d, F.struct("mean", "k"))).alias(f"_{d}") for d in drivers))
    j = usage.where(F.col("games") > 0).join(wide, "position")
    own = lambda d: (F.coalesce(F.col(d), F.lit(0)) + F.col(f"_{d}.k") * F.col(f"_{d}.mean")) / (F.col("games") + F.col(f"_{d}.k"))
    return j.select("player_id", "position", "games", *(F.coalesce(own(d), F.col(f"_{d}.mean")).alias(d) for d in drivers))


def rate_sums(frame: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Sufficient statistics of every (position, driver, stat) ridge in one aggregation."""
    xs = features
    rows = F.array(*(F.struct(F.lit(v).alias("driver"), F.lit(s).alias("stat"), F.col(v).cast("double").alias("vol"), F.try_divide(F.col(s), F.col(v)).alias("y")) for v, ss in RATES.items() for s in ss))
    long = frame.select("position", *(F.coalesce(F.col(x), F.lit(0.0)).alias(x) for x in xs), F.explode(rows).alias("r")).where("r.vol > 0").select("position", "r.driver", "r.stat", "r.y", *xs)
    sums = [F.count("*").alias("n"), F.sum("y").alias("y")]
    sums += [F.sum(x).alias(f"s_{x}") for x in xs] + [F.sum(F.col(x) * F.col("y")).alias(f"y_{x}") for x in xs]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"q_{a}__{b}") for i, a in enumerate(xs) for b in xs[i:]]
    return long.groupBy("position", "driver", "stat").agg(*sums)


def fit_rates(frame: DataFrame, alpha: float = 1.0, features: list[str] = FEATURES) -> dict[tuple[str, str, str], tuple[np.ndarray, float]]:
    """Standardised ridge per (position, driver, stat): weights on raw features, intercept."""
    out = {}
    for r in rate_sums(frame, features).collect():
        n = r["n"]
        s = np.array([r[f"s_{x}"] for x in features])
        q = np.array([[r[f"q_{a}__{b}"] if i <= j else r[f"q_{b}__{a}"] for j, b in enumerate(features)] for i, a in enumerate(features)])
        cov = q - np.outer(s, s) / n
        sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
        sd[sd == 0] = 1.0
        xy = np.array([r[f"y_{x}"] for x in features]) - s * r["y"] / n
        w = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(len(features)), xy / sd) / sd
        out[r["position"], r["driver"], r["stat"]] = (w, float(r["y"] / n - w @ s / n))
    return out


def stat_line(vol: DataFrame, talent: DataFrame, models: dict, features: list[str] = FEATURES) -> DataFrame:
    """Projected statistics a game: volume times predicted rate, never below 0; players
    without volume or model are left out."""
    j = vol.join(talent, "player_id")
    cols = {}
    for v, stats in RATES.items():
        for s in stats:
            each = []
            for (pos, driver, stat), (w, b) in models.items():
                if (driver, stat) == (v, s):
                    pred = sum((F.coalesce(F.col(x), F.lit(0.0)) * float(k) for x, k in zip(features, w)), F.lit(b))
                    pred = F.when(F.isnan(pred) | (F.abs(pred) == float("inf")), 0.0).otherwise(pred)
                    each.append(F.when(F.col("position") == pos, pred))
            rate = F.coalesce(*each, F.lit(0.0)) if each else F.lit(0.0)
            cols[s] = F.greatest(F.col(v) * rate, F.lit(0.0))
    known = [p for p, _, _ in models]
    return j.where(F.col("position").isin(sorted(set(known)))).select("player_id", "position", *VOLUME, *(c.alias(s) for s, c in cols.items()), F.lit(0.0).alias("two_point_conversions"))


def season_line(line: DataFrame, games: int = 17) -> DataFrame:
    return line.select(*(c if t in ("string",) else (F.col(c) * games).alias(c) for c, t in line.dtypes))


def points_map(frame: DataFrame, rating: str = "rating", least: int = 10) -> DataFrame:
    """Affine map rating -> points of each position with enough rows and some spread."""
    g = frame.where(F.col(rating).isNotNull() & F.col("points").isNotNull()).groupBy("position")
    m = g.agg(F.count("*").alias("n"), F.min(rating).alias("lo"), F.max(rating).alias("hi"), F.regr_slope("points", rating).alias("slope"), F.regr_intercept("points", rating).alias("intercept"))
    return m.where((F.col("n") >= least) & (F.col("hi") > F.col("lo"))).select("position", "n", "slope", "intercept")


def talent_features(ratings: DataFrame, smooth: DataFrame, prior: DataFrame) -> DataFrame:
    """Union of the three sources by player; 0 for a missing rating or talent, null prior."""
    return (
        ratings.select("player_id", F.col("rating").alias("rapm_rating"))
        .join(smooth.select("player_id", F.col("talent").alias("smoothed_talent")), "player_id", "full")
        .join(prior.select("player_id", "prior_mean"), "player_id", "full")
        .na.fill(0.0, ["rapm_rating", "smoothed_talent"])
    )
