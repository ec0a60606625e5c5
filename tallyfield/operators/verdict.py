"""The verdict over all origins: fitted ratings to forecasts, paired with baselines, judged.

Ratings of all origins come as one table and everything after is joins on (player, season): a
player's season is one short array of weeks, from which outcomes and baselines of each origin are
read, so no origin is a query of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators import evaluation, forecast, projection

HORIZONS = ("weekly", "rest_of_season")
BASELINES = ("persistence", "season_to_date", "last_season")
KILL = ("rest_of_season", "last_season")  # the margin that decides


def frozen_map(ratings: DataFrame, history: DataFrame, players: DataFrame) -> DataFrame:
    """Points map of each position from the first origin's ratings and the points before it,
    made once and used at every origin."""
    first = ratings.agg(F.min(F.struct("season", "week"))).first()[0]
    past = history.where((F.col("season") < first.season) | ((F.col("season") == first.season) & (F.col("week") < first.week)))
    at = ratings.where((F.col("season") == first.season) & (F.col("week") == first.week)).select("player_id", "rating")
    return projection.points_map(past.drop("position").join(at, "player_id").join(players.select("player_id", "position"), "player_id"))


def paired(forecasts: DataFrame, history: DataFrame) -> DataFrame:
    """(horizon, baseline, season, week, player_id, position, forecast, other, actual): every cell
    where the forecast, the baseline and the outcome are known.

    Baselines look at weeks before the origin only: the last one played, their mean, and the
    mean of the season before.
    """
    seasons = history.groupBy("player_id", "season").agg(F.sort_array(F.collect_list(F.struct("week", F.col("points").cast("double").alias("points")))).alias("_h"))
    last = seasons.select("player_id", (F.col("season") + 1).alias("season"), F.col("_h").alias("_l"))
    j = forecasts.join(seasons, ["player_id", "season"], "left").join(last, ["player_id", "season"], "left")
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x["points"]) / F.size(a))
    past = F.filter("_h", lambda x: x["week"] < F.col("week"))
    j = j.withColumns({
        "weekly": mean(F.filter("_h", lambda x: x["week"] == F.col("week"))), "rest_of_season": mean(F.filter("_h", lambda x: x["week"] >= F.col("week"))),
        "persistence": F.when(F.size(past) > 0, F.element_at(past, -1)["points"]), "season_to_date": mean(past), "last_season": mean(F.col("_l")),
    })
    cells = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(b).alias("baseline"), F.col(b).alias("other"), F.col(h).alias("actual")) for h in HORIZONS for b in BASELINES))
    e = j.select("season", "week", "player_id", "position", "forecast", F.explode(cells).alias("c"))
    return e.select("c.horizon", "c.baseline", "season", "week", "player_id", "position", "forecast", "c.other", "c.actual").where("forecast is not null and other is not null and actual is not null")


def margins(cells: DataFrame) -> DataFrame:
    """How much nearer the forecast was than the baseline, in each cell."""
    return cells.withColumn("margin", F.abs(F.col("other") - F.col("actual")) - F.abs(F.col("forecast") - F.col("actual")))


def report(cells: DataFrame, n: int = 10_000) -> DataFrame:
    """A row a horizon and baseline: errors, the margin with its week-clustered interval, the
    noise floor of sign-flipped margins and whether the margin passes it, and the verdict."""
    m = margins(cells)
    f, o, a = F.col("forecast"), F.col("other"), F.col("actual")
    plain = m.groupBy("horizon", "baseline").agg(F.count("*").alias("n"), evaluation.mae(f, a).alias("mae"), evaluation.mae(o, a).alias("baseline_mae"), evaluation.rmse(f, a).alias("rmse"))
    key = F.concat_ws("|", "horizon", "baseline", "player_id", F.col("season").cast("string"), F.col("week").cast("string"))
    sign = F.when(F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    null = m.withColumn("_s", sign * F.col("margin")).groupBy("horizon", "baseline").agg((F.avg("_s") + 1.96 * F.stddev_samp("_s") / F.sqrt(F.count("*"))).alias("floor"))
    parts = []
    for h in HORIZONS:
        for b in BASELINES:
            mine = m.where((F.col("horizon") == h) & (F.col("baseline") == b))
            parts.append(evaluation.cluster_bootstrap(mine, "margin", ["season", "week"], n).select(F.lit(h).alias("horizon"), F.lit(b).alias("baseline"), "point", "lower", "upper", "excludes_zero", "clusters"))
    j = plain.join(reduce(DataFrame.unionByName, parts), ["horizon", "baseline"]).join(null, ["horizon", "baseline"])
    decided = F.when((F.col("point") > 0) & F.col("excludes_zero"), "SHIP").otherwise("FALLBACK")
    return j.withColumn("passes", F.col("point") > F.col("floor")).withColumn("verdict", F.when((F.col("horizon") == KILL[0]) & (F.col("baseline") == KILL[1]), decided))


def verdict(rows: DataFrame) -> str:
    """SHIP, FALLBACK, or INCONCLUSIVE where no cell of the deciding margin is there."""
    got = rows.where("verdict is not null").select("verdict").collect()
    return got[0].verdict if got else "INCONCLUSIVE"


def run_verdict(ratings: DataFrame, history: DataFrame, players: DataFrame, n: int = 10_000) -> DataFrame:
    """The report from ratings (season, week, player_id, rating) of all origins."""
    people = players.dropDuplicates(["player_id"]).select("player_id", "position")
    f = forecast.weekly_points(ratings.join(people, "player_id"), frozen_map(ratings, history, people))
    return report(paired(f, history), n)
