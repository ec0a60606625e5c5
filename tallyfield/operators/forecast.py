"""Forecasts from ratings, their baselines, scoring with an offset, resampling, and the verdict."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators import asof
from tallyfield.operators.asof import AsOf
from tallyfield.operators.records import COMPONENTS

# --- scoring -----------------------------------------------------------------------------


def affine_points(weights: list[tuple[str, float]], offset: float = 0.0, units: int = 100) -> Column:
    """Points as a weighted sum of statistics plus an offset.

    A component that stands twice, one outside the vocabulary, or a number that isn't finite is
    refused, as the sum would no longer be what the profile says. Weights are kept in
    ``1 / units``, so that sums are exact in integers; finer ones are refused, too.
    """
    known = {c for c, _, _ in COMPONENTS}
    seen: set[str] = set()
    total = F.lit(0)
    for name, w in weights:
        if name not in known or name in seen:
            raise ValueError(f"{name} is {'repeated' if name in seen else 'no component'}")
        if not math.isfinite(w) or abs(w * units - round(w * units)) > 1e-9:
            raise ValueError(f"weight {w} of {name}")
        seen.add(name)
        total = total + round(w * units) * F.coalesce(F.col(name), F.lit(0))
    if not math.isfinite(offset) or abs(offset * units - round(offset * units)) > 1e-9:
        raise ValueError(f"offset {offset}")
    return (total + round(offset * units)).cast("double") / units


# --- forecasts and baselines -------------------------------------------------------------


def weekly_points(ratings: DataFrame, points_map: DataFrame) -> DataFrame:
    """Forecast of every rated player and origin (player_id, position, season, week, rating)
    through the affine map of the position; positions without a map are left out, not guessed."""
    m = points_map.select("position", "slope", "intercept")
    return ratings.join(F.broadcast(m), "position").withColumn("forecast", F.col("slope") * F.col("rating") + F.col("intercept")).select("season", "week", "player_id", "position", "forecast")


def rest_of_season_points(per_game: DataFrame, at: AsOf, weeks: int = 18) -> DataFrame:
    """Points over the weeks left, of (player_id, position, points_pg); players whose figure is
    missing are left out."""
    left = weeks - at.week + 1
    return per_game.where("points_pg is not null").select("player_id", "position", (F.col("points_pg") * left).alias("forecast"), F.lit(left).alias("games"))


# name -> forecast of (history, origin) as (player_id, forecast)
BASELINES: dict[str, Callable[[DataFrame, AsOf], DataFrame]] = {
    "persistence": asof.persistence,
    "season_to_date": asof.season_to_date,
    "last_season": asof.last_season,
}


def default_baselines(history: DataFrame, at: AsOf) -> DataFrame:
    """All default baselines, one row a player and baseline."""
    out = None
    for name, f in BASELINES.items():
        one = f(history, at).select(F.lit(name).alias("baseline"), "player_id", "forecast")
        out = one if out is None else out.unionByName(one)
    return out


# --- errors that compare over positions --------------------------------------------------


def position_scales(history: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Mean absolute deviation within a week of each position's top outcomes, over a training
    period: fixed before any forecast is seen."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("season", "week", "position").orderBy(F.col("points").desc(), "player_id"))
    need = F.create_map(*(x for p, n in sizes.items() for x in (F.lit(p), F.lit(n))))[F.col("position")]
    top = history.withColumn("_r", rank).where(F.col("_r") <= need)
    dev = F.abs(F.col("points") - F.avg("points").over(Window.partitionBy("season", "week", "position")))
    return top.withColumn("_d", dev).groupBy("position").agg(F.avg("_d").alias("scale"))


def balanced_mae(cells: DataFrame, scales: DataFrame) -> DataFrame:
    """Mean over positions of the error over the position's scale, of forecast and baseline."""
    e = cells.groupBy("position").agg(F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("e"), F.avg(F.abs(F.col("baseline") - F.col("actual"))).alias("b"))
    g = e.join(F.broadcast(scales), "position").agg(F.avg(F.col("e") / F.col("scale")).alias("engine"), F.avg(F.col("b") / F.col("scale")).alias("baseline"))
    return g.withColumn("improvement", (F.col("baseline") - F.col("engine")) / F.col("baseline"))


# --- resampling and verdict --------------------------------------------------------------

HEX = 12  # digits of the hash that decide a draw
_CUM, _p, _c = [], math.exp(-1.0), 0.0
for _k in range(12):  # counts above have no chance at this precision
    _c += _p
    _CUM.append(int(_c * 16**HEX))
    _p /= _k + 1


def poisson_count(u: Column) -> Column:
    """Poisson(1) count of a hash of HEX digits, by its cumulative probabilities."""
    return sum(((u >= F.lit(c)).cast("int") for c in _CUM[1:]), (u >= F.lit(_CUM[0])).cast("int"))


def iid_bootstrap(units: DataFrame, value: str, key: list[str], n: int = 200, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Percentile interval of a mean from Poisson resamples of single units.

    How often a replicate takes a unit is a hash of both, so reruns agree whatever the
    partitions; only (sum, count) of a replicate are shuffled, never n * units rows.
    """
    by = by or []
    rep = units.select(*by, *key, F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("iid"), F.col("rep").cast("string"), *(F.col(k).cast("string") for k in key))), 1, HEX), 16, 10).cast("long")
    rep = rep.withColumn("_m", poisson_count(u))
    means = rep.groupBy(*by, "rep").agg((F.sum(F.col("_m") * F.col("_v")) / F.sum("_m")).alias("mean"))
    q = lambda p: F.expr(f"percentile(mean, {p})")
    point = units.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("point"))
    if by:
        band = means.groupBy(*by).agg(q(alpha / 2).alias("lower"), q(1 - alpha / 2).alias("upper"))
        out = point.join(band, by)
    else:
        out = point.crossJoin(F.broadcast(means.agg(q(alpha / 2).alias("lower"), q(1 - alpha / 2).alias("upper"))))  # one row each
    return out.withColumn("excludes_zero", (F.col("lower") > 0) | (F.col("upper") < 0))


def decide(margins: DataFrame) -> DataFrame:
    """The verdict on a table of at most one row (n, point, lower, upper, excludes_zero): the
    rest-of-season margin over last season's mean."""
    one = margins.agg(F.count("*").alias("rows"), F.max("n").alias("n"), F.max("point").alias("point"), F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.max("excludes_zero").alias("ok"))
    v = F.when((F.col("rows") == 0) | (F.coalesce("n", F.lit(0)) == 0), "INCONCLUSIVE").when((F.col("point") > 0) & F.col("ok"), "SHIP").otherwise("FALLBACK")
    return one.select(v.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n"), "point", "lower", "upper")


def promote(registry: dict, name: str, null: dict, label: str) -> dict:
    """Add a gate's noise floor (n, mean, threshold) once; a gate that is there stays."""
    return registry if name in registry else {**registry, name: {**null, "run": label}}


def gate_check(registry: dict, name: str, value: float) -> bool | None:
    """Whether a value passes its gate; None without one."""
    return None if name not in registry else value > registry[name]["threshold"]


# --- parity ------------------------------------------------------------------------------


def compare(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """Per column: rows of both, on one side only, and apart by more than the tolerances.

    Without tolerances numbers must be equal bit for bit (NaN equals NaN, 0.0 and -0.0 don't).
    """
    a = left.select(*keys, F.lit(1).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in columns))
    b = right.select(*keys, F.lit(1).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in columns))
    j = a.join(b, keys, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def apart(c: str) -> Column:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        if absolute or relative:
            same = F.coalesce(F.abs(x - y) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(x), F.abs(y))), F.lit(False)) | x.eqNullSafe(y)
        else:
            same = x.eqNullSafe(y) & (F.hex(x.cast("string")).eqNullSafe(F.hex(y.cast("string"))))
        return F.count(F.when(both & ~same, 1)).alias(f"apart_{c}")

    return j.agg(F.count(F.when(both, 1)).alias("both"), F.count(F.when(F.col("_b").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("_a").isNull(), 1)).alias("right_only"), *(apart(c) for c in columns))
