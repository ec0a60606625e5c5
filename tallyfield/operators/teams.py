"""Team effects from on-field exposure, market rows on net strength, windows of seasons, and
the loop that couples ratings and credit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = (("off_team", "off_players"), ("def_team", "def_players"))


def exposure(plays: DataFrame) -> DataFrame:
    """(side, team, player_id, share): a player's plays with the team's side over its plays."""
    out = None
    for team, players in SIDES:
        counted = plays.groupBy(F.col(team).alias("team")).agg(F.count("*").alias("n"))
        on = plays.select(F.col(team).alias("team"), F.explode(players).alias("player_id")).groupBy("team", "player_id").agg(F.count("*").alias("m"))
        one = on.join(counted, "team").select(F.lit(team[:3]).alias("side"), "team", "player_id", (F.col("m") / F.col("n")).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


def team_effects(plays: DataFrame, ratings: DataFrame, intercepts: DataFrame) -> DataFrame:
    """e_off, e_def, net strength and grade (+e_def, higher is tougher) of each team.

    ``ratings``: (player_id, rating), unrated players count 0; ``intercepts``: (side, team, value).
    """
    e = exposure(plays).join(ratings.select("player_id", "rating"), "player_id", "left")
    e = e.groupBy("side", "team").agg(F.sum(F.col("share") * F.coalesce("rating", F.lit(0.0))).alias("carried"))
    e = e.join(intercepts.select("side", "team", "value"), ["side", "team"], "left").withColumn("effect", F.col("carried") + F.coalesce("value", F.lit(0.0)))
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("effect"))), F.lit(0.0))
    g = e.groupBy("team").agg(side("off").alias("e_off"), side("def").alias("e_def"))
    return g.select("team", "e_off", "e_def", (F.col("e_off") + F.col("e_def")).alias("net"), F.col("e_def").alias("grade"))


def net_market_rows(plays: DataFrame) -> DataFrame:
    """(team, col, val): rows that tie a team's market strength to its net strength, whatever
    constant moves between players and intercepts."""
    e = exposure(plays)
    own = e.select("team", "side").distinct().select("team", F.concat(F.substring("side", 1, 1), F.lit(":"), F.col("team")).alias("col"), F.lit(1.0).alias("val"))
    held = e.groupBy("team", F.concat(F.lit("p:"), "player_id").alias("col")).agg(F.sum("share").alias("val"))
    return own.unionByName(held)


def window_blocks(blocks: DataFrame, season: int, week: int, research: bool = False) -> DataFrame:
    """Blocks that an origin may use: the three seasons before at a preseason or first-week
    origin, the two before later; ``research`` adds the season's own earlier weeks, and its
    rows say so."""
    first = season - (3 if week <= 1 else 2)
    keep = (F.col("season") >= first) & (F.col("season") < season)
    if research:
        keep = keep | ((F.col("season") == season) & (F.col("week") < week))
    return blocks.where(keep).withColumn("research_only", F.lit(research))


def fixed_point(solve: Callable[[dict[str, float]], dict[str, float]], credit: Callable[[dict[str, float]], float], focus: str, rounds: int = 3) -> tuple[dict[str, float], list[float]]:
    """Ratings and the focus player's credit, each from the other, ``rounds`` times.

    ``solve`` takes prior means to ratings (the Gram sums stay as they are, so a round is a
    solve and no pass over the plays); ``credit`` takes ratings to the player's mean weekly
    credit, which is the next prior mean. Returns the ratings and the credits of the rounds.
    """
    prior: dict[str, float] = {}
    ratings: dict[str, float] = {}
    credits = []
    for _ in range(rounds):
        ratings = solve(prior)
        credits.append(credit(ratings))
        prior = {focus: credits[-1]}
    return ratings, credits


def opponent_residual(valued: DataFrame, cell: str, folds: str, penalty: float = 1.0) -> DataFrame:
    """dv less what state cell and the defenders' rating sum (``def_sum``) explain, out of fold.

    Within a cell dv is a line in def_sum, its slope shrunk by ``penalty``; sums of a cell and
    fold are all that is shuffled, and a row's own fold is taken out of them.
    """
    x, y = F.col("def_sum"), F.col("dv")
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "sxy": F.sum(x * y)}
    part = valued.groupBy(F.col(cell).alias("_c"), F.col(folds).alias("_f")).agg(*(s.alias(k) for k, s in sums.items()))
    whole = part.groupBy("_c").agg(*(F.sum(k).alias(f"t_{k}") for k in sums))
    p = part.join(whole, "_c").select("_c", "_f", *((F.col(f"t_{k}") - F.col(k)).alias(k) for k in sums))
    n = F.col("n")
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / (F.col("sxx") - F.col("sx") * F.col("sx") / n + penalty)
    p = p.select("_c", "_f", F.when(n > 0, F.col("sx") / n).otherwise(0.0).alias("_mx"), F.when(n > 0, F.col("sy") / n).otherwise(0.0).alias("_my"), F.when(n > 1, slope).otherwise(0.0).alias("_b"))
    j = valued.join(F.broadcast(p), (valued[cell] == p._c) & (valued[folds] == p._f))  # a row a cell and fold
    return j.withColumn("resid", y - F.col("_my") - F.col("_b") * (x - F.col("_mx"))).drop("_c", "_f", "_mx", "_my", "_b")


def qb_credit(residuals: DataFrame, players: DataFrame, least: int = 20) -> DataFrame:
    """Mean residual a week of every quarterback with at least ``least`` plays; any failure shows."""
    qb = players.where("position = 'QB'").select("player_id")
    on = residuals.select("season", "week", "resid", F.explode("off_players").alias("player_id")).join(F.broadcast(qb), "player_id")
    g = on.groupBy("player_id", "season", "week").agg(F.avg("resid").alias("credit"), F.count("*").alias("snaps"))
    enough = g.groupBy("player_id").agg(F.sum("snaps").alias("_n")).where(F.col("_n") >= least).select("player_id")
    return g.join(enough, "player_id", "left_semi")


def remap_state(state: DataFrame, roster: DataFrame, start: dict[str, float]) -> DataFrame:
    """State of the roster's players: what was known of them, else the start values."""
    return roster.join(state, "player_id", "left").select(*roster.columns, *(F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in start.items()))
