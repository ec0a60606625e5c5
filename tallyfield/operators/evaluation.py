"""Forecast metrics, calibration, ranking, resampling, walk-forward and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.normal import cdf, pdf, ppf


def mae(pred: Column, actual: Column) -> Column:
    return F.avg(F.abs(pred - actual))


def rmse(pred: Column, actual: Column) -> Column:
    return F.sqrt(F.avg(F.pow(pred - actual, 2)))


def bias(pred: Column, actual: Column) -> Column:
    return F.avg(pred - actual)


def skill(score: Column, reference: Column) -> Column:
    return F.when(reference == 0, 0.0).otherwise(1 - score / reference)


def nis(actual: Column, mean: Column, var: Column) -> Column:
    return F.avg(F.pow(actual - mean, 2) / var)


def pit(actual: Column, mean: Column, sd: Column) -> Column:
    return cdf((actual - mean) / sd)


def crps(actual: Column, mean: Column, sd: Column) -> Column:
    """Of one Gaussian forecast; average it for the score."""
    z = (actual - mean) / sd
    return sd * (z * (2 * cdf(z) - 1) + 2 * pdf(z) - 1 / math.sqrt(math.pi))


def picp(actual: Column, mean: Column, sd: Column, level: float = 0.8) -> Column:
    half = sd * ppf((1 + level) / 2)
    return F.avg(actual.between(mean - half, mean + half).cast("double"))


def pinaw(actual: Column, sd: Column, level: float = 0.8) -> Column:
    span = F.max(actual) - F.min(actual)
    return F.when(span == 0, 0.0).otherwise(F.avg(sd) * 2 * ppf((1 + level) / 2) / span)


def pinball(actual: Column, quantile: Column, q: float) -> Column:
    d = actual - quantile
    return F.avg(F.greatest(d * q, d * (q - 1)))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1, ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, pred: str, actual: str, by: list[str]) -> DataFrame:
    """Rank correlation per group: null under two rows, 0 without spread."""
    r = df.withColumns({"_p": average_rank(pred, by), "_a": average_rank(actual, by)})
    c = F.try_divide(F.covar_pop("_p", "_a"), F.stddev_pop("_p") * F.stddev_pop("_a"))
    g = r.groupBy(*by).agg(F.count("*").alias("n"), c.alias("c"))
    return g.select(*by, "n", F.when(F.col("n") < 2, None).otherwise(F.coalesce("c", F.lit(0.0))).alias("spearman"))


def top_n_hits(df: DataFrame, pred: str, actual: str, n: int, by: list[str], key: str) -> DataFrame:
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(c).desc(), key))
    r = df.withColumns({"_p": rank(pred), "_a": rank(actual)})
    return r.groupBy(*by).agg((F.sum(((F.col("_p") <= n) & (F.col("_a") <= n)).cast("int")) / F.least(F.lit(n), F.count("*"))).alias("hit_rate"))


def ndcg(df: DataFrame, pred: str, actual: str, k: int, by: list[str], key: str) -> DataFrame:
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(c).desc(), key))
    r = df.withColumns({"_p": rank(pred), "_a": rank(actual)})
    gain = lambda c: F.sum(F.when(F.col(c) <= k, F.col(actual) / F.log2(F.col(c) + 1)).otherwise(0.0))
    return r.groupBy(*by).agg(gain("_p").alias("dcg"), gain("_a").alias("idcg")).select(*by, F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def top_with_ties(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rows whose rank by ``value``, from the greatest, is at most n, ties included: those at or
    above the n-th value, which a top-n of each partition finds. Fewer than n rows are all in."""
    least = df.select(value).where(F.col(value).isNotNull()).orderBy(F.col(value).desc()).limit(n).agg(F.min(value).alias("_least"))
    return df.crossJoin(F.broadcast(least)).where(F.col(value) >= F.col("_least")).drop("_least")  # one row


def strictly_earlier_sd(df: DataFrame, error: str, slot: str, by: list[str], least: int = 20) -> DataFrame:
    """Spread of the errors of earlier slots only, null under ``least`` of them."""
    w = Window.partitionBy(*by).orderBy(slot).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("prior_sd", F.when(F.count(error).over(w) >= least, F.stddev_samp(error).over(w)))


def draw(replicate: Column, position: Column, size: Column, salt: str = "boot") -> Column:
    """Index in [0, size) that a replicate draws at a position: a hash, so reruns agree."""
    key = F.concat_ws("|", F.lit(salt), replicate.cast("string"), position.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") % size


def cluster_bootstrap(units: DataFrame, value: str, cluster: list[str], n: int = 200, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a mean, clusters drawn with replacement.

    Units are summed per cluster first; a replicate draws as many clusters as there are, and
    only (sum, count) are added up, so n * clusters rows are made, never n * units.
    """
    c = units.groupBy(*cluster).agg(F.sum(value).alias("s"), F.count(value).alias("m"))
    every = Window.partitionBy(F.lit(0))
    c = c.withColumn("i", F.row_number().over(every.orderBy(*cluster)) - 1).withColumn("size", F.count("*").over(every))
    draws = c.select("i", "size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    draws = draws.select("rep", draw(F.col("rep"), F.col("i"), F.col("size")).cast("int").alias("i"))
    means = draws.join(c.select("i", "s", "m"), "i").groupBy("rep").agg((F.sum("s") / F.sum("m")).alias("mean"))
    band = means.agg(F.expr(f"percentile(mean, {alpha / 2})").alias("lower"), F.expr(f"percentile(mean, {1 - alpha / 2})").alias("upper"))
    point = c.agg((F.sum("s") / F.sum("m")).alias("point"), F.count("*").alias("clusters"))
    return point.crossJoin(F.broadcast(band)).withColumn("excludes_zero", (F.col("lower") > 0) | (F.col("upper") < 0))


def gate(samples: DataFrame, value: str) -> DataFrame:
    """Threshold of a null distribution: mean + 1.96 standard errors."""
    return samples.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).withColumn("threshold", F.col("mean") + 1.96 * F.col("sd") / F.sqrt("n"))


def skill_report(cells: DataFrame) -> DataFrame:
    """Skill and error per position and over all: (position, forecast, baseline, actual) in."""
    f, b, a = F.col("forecast"), F.col("baseline"), F.col("actual")
    g = cells.groupingSets([["position"], []], "position").agg(
        F.grouping("position").alias("_all"), F.count("*").alias("n"), mae(f, a).alias("mae"), rmse(f, a).alias("rmse"), bias(f, a).alias("bias"), mae(b, a).alias("baseline_mae"), F.avg(F.abs(b - a) - F.abs(f - a)).alias("margin")
    )
    return g.withColumn("skill", skill(F.col("mae"), F.col("baseline_mae"))).select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("position")).alias("position"), "n", "mae", "rmse", "bias", "margin", "skill")


def scorecard(cells: DataFrame, scales: DataFrame, level: float = 0.8) -> DataFrame:
    """Scores by week and position, by week, by position and over all (null week or position).

    ``cells``: week, position, forecast, sd, p_active and actual, which is null for an inactive
    player. Errors, ranks and coverage are of active players; the Brier score is of all.
    ``rank_accuracy`` is (1 + rank correlation) / 2 within a week and position, averaged;
    ``pb_mae`` the mean over positions of the error over the position's scale. A score that
    can't be had is null. All rows come from one sum a week and position.
    """
    active = F.col("actual").isNotNull()
    e = F.col("forecast") - F.col("actual")
    half = F.col("sd") * ppf((1 + level) / 2)
    by = ["week", "position"]
    base = cells.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("actual").alias("m"), F.sum(F.abs(e)).alias("ae"), F.sum(e * e).alias("se"),
        F.sum(F.pow(F.col("p_active") - active.cast("int"), 2)).alias("br"), F.sum((F.abs(e) <= half).cast("int")).alias("cov"),
    )
    rounded = cells.where(active).withColumn("forecast", F.round("forecast", 6))  # ties don't hang on the order of a sum
    ranks = spearman(rounded, "forecast", "actual", by).select(*by, ((1 + F.col("spearman")) / 2).alias("rank"))
    base = base.join(ranks, by, "left").join(F.broadcast(scales), "position", "left")  # a row a position
    add = lambda g: g.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("ae").alias("ae"), F.sum("se").alias("se"), F.sum("br").alias("br"), F.sum("cov").alias("cov"), F.avg("rank").alias("rank"))
    scaled = lambda df, keys: df.groupBy(*keys, "position").agg((F.sum("ae") / F.sum("m") / F.first("scale")).alias("x")).groupBy(*keys).agg(F.avg("x").alias("pb"))
    null = {"week": F.lit(None).cast("int"), "position": F.lit(None).cast("string")}
    out = None
    for keys in (by, ["week"], ["position"], []):
        pb = scaled(base, keys)
        one = add(base.groupBy(*keys)).join(pb, keys) if keys else add(base.groupBy()).crossJoin(F.broadcast(pb))  # one row each
        one = one.withColumns({k: c for k, c in null.items() if k not in keys}).select(*by, "n", "m", "ae", "se", "br", "cov", "rank", "pb")
        out = one if out is None else out.unionByName(one)
    m = F.when(F.col("m") > 0, F.col("m"))
    return out.select("week", "position", "n", F.col("pb").alias("pb_mae"), (F.col("ae") / m).alias("mae"), F.sqrt(F.col("se") / m).alias("rmse"), F.col("rank").alias("rank_accuracy"), (F.col("br") / F.col("n")).alias("brier_active"), (F.col("cov") / m).alias("interval_coverage"))


def cumulative_blocks(blocks: DataFrame) -> DataFrame:
    """Gram sums over strictly earlier slots, at every slot: (season, week, i, j, v)."""
    slot = F.col("season") * 100 + F.col("week")
    w = Window.partitionBy("i", "j").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("v", F.sum("v").over(w)).where(F.col("v").isNotNull())


def walk_forward_ratings(states: DataFrame, players: DataFrame, warmup_weeks: int = 4, lam: float = 120.0, market: DataFrame | None = None, origin_stride: int = 1, stretch: int = 8) -> DataFrame:
    """Ratings (season, week, col, rating) at every slot after the warm-up (every
    ``origin_stride``-th of them), each from the blocks of earlier slots alone.

    Cell values are those of the warm-up's plays; a cell that the warm-up has not seen takes
    the warm-up's mean. Blocks are made once and solved on the executors, ``stretch`` origins a
    task; the driver knows the slots only.
    """
    from tallyfield.operators.attribution import STATE, market_rows, play_gram, play_values, state_bucket
    from tallyfield.operators.solver import solve_stretches, stretches
    from tallyfield.session import removed, written

    if warmup_weeks < 1 or origin_stride < 1:
        raise ValueError("warmup_weeks and origin_stride count from 1")
    at = lambda n: state_bucket(*(F.col(n + c) for c in STATE)).alias("bucket")
    none = F.lit(None).cast("double").alias("p")
    seen = F.explode(F.array(F.struct(at(""), F.col("drive_points").cast("double").alias("p")), F.struct(at("n_"), none))).alias("e")
    # counts and sums of a slot and bucket: slots, buckets and the warm-up's means come from one pass
    seen, seen_at = written(states.select("season", "week", seen).groupBy("season", "week", "e.bucket").agg(F.sum("e.p").alias("p"), F.count("e.p").alias("n")))
    slots = sorted((r.season, r.week) for r in seen.select("season", "week").distinct().collect())
    if len(slots) <= warmup_weeks:
        removed(states.sparkSession, seen_at)
        raise ValueError(f"{len(slots)} slots leave no origin after a warm-up of {warmup_weeks}")
    season, week = slots[warmup_weeks]
    warm = seen.where((F.col("season") < season) | ((F.col("season") == season) & (F.col("week") < week)))
    mean = warm.agg(F.sum("p") / F.sum("n")).first()[0]
    known = warm.groupBy("bucket").agg((F.sum("p") / F.sum("n")).alias("value"))
    values = seen.where("bucket is not null").select("bucket").distinct().join(known, "bucket", "left").withColumn("value", F.coalesce("value", F.lit(mean)))
    blocks = play_gram(play_values(states, values), players)
    if market is not None:  # pseudo-plays of the first slot, which every origin has behind it
        first = [F.lit(x).cast("int").alias(c) for c, x in zip(("season", "week"), slots[0])]
        blocks = blocks.unionByName(market_rows(market).select(*first, "i", "j", "v"))
    origins = slots[warmup_weeks::origin_stride]
    return solve_stretches(stretches(blocks, slots, origins, stretch), slots, origins, stretch, lam)


def walk_forward(states: DataFrame, players: DataFrame, warmup_weeks: int = 4, lam: float = 120.0, market: DataFrame | None = None, origin_stride: int = 1) -> dict[tuple[int, int], dict[str, float]]:
    """The same as {origin: {column: rating}} on the driver, which holds the ratings alone."""
    out: dict[tuple[int, int], dict[str, float]] = {}
    for r in walk_forward_ratings(states, players, warmup_weeks, lam, market, origin_stride).toLocalIterator():
        out.setdefault((r.season, r.week), {})[r.col] = r.rating
    return {k: out[k] for k in sorted(out)}
