"""Scoring, value over replacement, tiers, snake order, draft and lineups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLEX = ["RB", "WR", "TE"]


def points(rules: dict[str, float], offset: float = 0.0) -> Column:
    """Affine scoring of a stat line; a missing statistic counts 0."""
    total = F.lit(float(offset))
    for stat, weight in rules.items():
        if not isinstance(weight, (int, float)):
            raise ValueError(f"scoring of {stat} is not linear")
        total = total + F.coalesce(F.col(stat), F.lit(0)) * F.lit(float(weight))
    return total


def value_over_replacement(pool: DataFrame, slots: dict[str, int], teams: int, by: Iterable[str] = ()) -> DataFrame:
    """Add replacement, vor and rank; ``by`` names columns that part independent pools.

    The replacement level of a position is the player at 0-based rank slots * teams, else
    the last one; FLEX positions take the larger of that and the pooled FLEX level.
    """
    by = list(by)
    in_position = Window.partitionBy(*by, "position").orderBy(F.col("projected_points").desc(), "player_id")
    whole = Window.partitionBy(*by, "position")
    need = F.coalesce(*(F.when(F.col("position") == p, F.lit(n * teams)) for p, n in slots.items() if p != "FLEX"))
    df = pool.withColumn("_rn", F.row_number().over(in_position)).withColumn("_need", need)
    own = F.coalesce(F.max(F.when(F.col("_rn") == F.col("_need") + 1, F.col("projected_points"))).over(whole), F.min("projected_points").over(whole))
    df = df.withColumn("_own", F.when(F.col("_need").isNotNull(), own))
    is_flex = F.col("position").isin(FLEX)
    if slots.get("FLEX", 0) > 0:
        flex_need = (sum(slots.get(p, 0) for p in FLEX) + slots["FLEX"]) * teams
        flex_order = Window.partitionBy(*by, is_flex).orderBy(F.col("projected_points").desc(), "player_id")
        flex_all = Window.partitionBy(*by, is_flex)
        df = df.withColumn("_frn", F.row_number().over(flex_order))
        level = F.coalesce(F.max(F.when(F.col("_frn") == flex_need + 1, F.col("projected_points"))).over(flex_all), F.min("projected_points").over(flex_all))
        df = df.withColumn("replacement", F.when(is_flex, F.greatest("_own", level)).otherwise(F.col("_own"))).drop("_frn")
    else:
        df = df.withColumn("replacement", F.col("_own"))
    df = df.withColumn("vor", F.when(F.col("replacement").isNull(), 0.0).otherwise(F.col("projected_points") - F.col("replacement")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("vor").desc(), "player_id"))
    return df.withColumn("rank", rank).drop("_rn", "_need", "_own")


def tiers(valued: DataFrame, max_gap: float = 0.10, by: Iterable[str] = ()) -> DataFrame:
    """A new tier wherever the gap to the player above passes ``max_gap`` of its value."""
    order = Window.partitionBy(*by).orderBy("rank")
    before = F.lag("vor").over(order)
    gap = (before - F.col("vor")) / F.when(before == 0, 1.0).otherwise(F.abs(before))
    df = valued.withColumn("_cut", F.coalesce((gap > max_gap).cast("int"), F.lit(0)))
    return df.withColumn("tier", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_cut")


def snake_order(leagues: DataFrame, rounds: int) -> DataFrame:
    """(pick, round, team) of a snake draft, all from 1, for every row of ``leagues``, which has
    ``teams``; its other columns stay."""
    n = leagues.withColumn("_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("teams") * rounds - 1)))
    r, i = F.expr("_id div teams"), F.col("_id") % F.col("teams")
    return n.select(*leagues.columns, (F.col("_id") + 1).alias("pick"), (r + 1).alias("round"), F.when(r % 2 == 0, i + 1).otherwise(F.col("teams") - i).alias("team"))


def within_reach(ranked: DataFrame, picks: int, by: list[str]) -> DataFrame:
    """Players that a draft of so many picks can take: nobody behind as many better ones of
    their own position is ever reached, so nothing is cut that could matter."""
    order = F.row_number().over(Window.partitionBy(*by, "position").orderBy("rank", "player_id"))
    return ranked.withColumn("_r", order).where(F.col("_r") <= picks).drop("_r")


def draft(pool: list[dict], slots: dict[str, int], teams: int, rounds: int) -> list[list[dict]]:
    """Snake draft of ranked players: a team's open slots first, then the best there is.

    Players wait in one queue a position, so a pick looks at the heads of the queues alone.
    A draft is sequential over teams * rounds picks; it runs on the driver over what is
    within its reach.
    """
    queues: dict[str, list[tuple[int, str, dict]]] = {}
    for p in pool:
        queues.setdefault(p["position"], []).append((p["rank"], p["player_id"], p))
    for q in queues.values():
        q.sort(key=lambda x: x[:2], reverse=True)
    held: list[list[dict]] = [[] for _ in range(teams)]
    used = [dict.fromkeys(slots, 0) for _ in range(teams)]

    def slot_for(team: int, position: str) -> str | None:
        for s in (position, "FLEX" if position in FLEX else None):
            if s in slots and used[team][s] < slots[s]:
                return s
        return None

    for k in range(teams * rounds):
        lap, i = divmod(k, teams)
        team = teams - 1 - i if lap % 2 else i
        heads = [p for p, q in queues.items() if q]
        if not heads:
            break
        best = min(heads, key=lambda p: (slot_for(team, p) is None, queues[p][-1][:2]))
        slot = slot_for(team, best)
        if slot is not None:
            used[team][slot] += 1
        held[team].append(queues[best].pop()[2])
    return held


def lineup(roster: DataFrame, slots: dict[str, int], by: list[str]) -> DataFrame:
    """Starters of each roster: (by..., player_id, position, projection, is_out) in.

    The greedy rule takes one total order, so it equals two ranks: within a position up to
    its need, then among what is left of the FLEX positions.
    """
    order = [F.coalesce(F.col("projection"), F.lit(0.0)).desc(), F.col("player_id")]
    need = F.coalesce(*(F.when(F.col("position") == p, F.lit(n)) for p, n in slots.items() if p != "FLEX"), F.lit(0))
    df = roster.where(~F.coalesce(F.col("is_out"), F.lit(False)))
    df = df.withColumn("_dedicated", F.row_number().over(Window.partitionBy(*by, "position").orderBy(*order)) <= need)
    open_flex = ~F.col("_dedicated") & F.col("position").isin(FLEX)
    df = df.withColumn("_open", open_flex)
    flex_rank = F.row_number().over(Window.partitionBy(*by, "_open").orderBy(*order))
    return df.where(F.lit(True)).withColumn("_f", flex_rank).where(F.col("_dedicated") | F.col("_open") & (F.col("_f") <= slots.get("FLEX", 0))).drop("_dedicated", "_open", "_f")


def rank_bands(ranks: DataFrame, elites: DataFrame, top_k: int = 5, min_in_top: int = 3, max_rank: int = 24) -> DataFrame:
    """One row: how many elites rank in the top, the worst of them, how many are missing, and the verdict."""
    j = elites.select("player_id").join(ranks.select("player_id", "rank"), "player_id", "left")
    out = j.agg(
        F.count(F.when(F.col("rank") <= top_k, 1)).alias("in_top"),
        F.count(F.when(F.col("rank") > max_rank, 1)).alias("too_low"),
        F.count(F.when(F.col("rank").isNull(), 1)).alias("missing"),
    )
    return out.withColumn("passed", (F.col("in_top") >= min_in_top) & (F.col("too_low") == 0))
