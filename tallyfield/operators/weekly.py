"""The weekly update: blocks, ratings, filter states, trajectory and grades of a week, entered
in one commit.

The steps write into a transaction of the store, so they appear together or not at all, and a
run that dies and starts again enters the same. A week at or below the high-water mark is a
correction: its block is replaced and every week from it on is solved and filtered again, from
the filter's state before it, so weeks may come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators import attribution, ingest, solver, statespace
from tallyfield.operators.teams import remap_state
from tallyfield.session import written
from tallyfield.sources.commits import Transaction
from tallyfield.sources.store import Store

OVERALL = "overall"
LEAST = 50  # plays of a situation in a week
LAMBDA = 120.0
MARK = "week_high_water"
SKILL, DEFENCE = ["QB", "RB", "WR", "TE"], ["DEF"]


def week_blocks(valued: DataFrame, players: DataFrame) -> DataFrame:
    """Gram blocks of a week's plays, over all of them and per situation with enough plays."""
    named = ingest.situations(valued).select(*valued.columns, "situation")
    enough = named.groupBy("situation").count().where(F.col("count") >= LEAST).select("situation")
    both = valued.withColumn("situation", F.lit(OVERALL)).unionByName(named.join(enough, "situation", "left_semi"))
    return attribution.play_gram(both, players, ["season", "week", "situation"]).select("season", "week", "situation", "i", "j", "v")


def ratings(blocks: DataFrame, market: DataFrame | None) -> DataFrame:
    """(situation, col, rating): one system a situation; the market rows anchor the overall one."""
    g = blocks.select("situation", "i", "j", "v")
    if market is not None:
        g = g.unionByName(attribution.market_rows(market).select(F.lit(OVERALL).alias("situation"), "i", "j", "v"))
    return solver.solve_by(g, ["situation"], LAMBDA)


def resets(players: DataFrame, coaching: DataFrame, season: int, week: int) -> DataFrame:
    """Players whose scheme changes with a coach of their team, by what the coach's role touches."""
    now = coaching.where((F.col("season") == season) & (F.col("week") == week)).select("team", "role").distinct()
    touched = F.when(F.col("role").isin("HC", "OC"), F.col("position").isin(SKILL)).otherwise(F.col("position").isin(DEFENCE))
    return players.join(now, "team").where(touched).select("player_id").distinct()


def next_state(before: DataFrame | None, rated: DataFrame, players: DataFrame, events: DataFrame, reset: DataFrame) -> DataFrame:
    """Filter states after a week in which each player's rating is observed; those whose
    innovation passes the threshold have an event of their own."""
    start = {k: v for k, v in zip(statespace.STATE, (0.0, 0.0, 0.0, statespace.START_VAR[0], 0.0, 0.0, statespace.START_VAR[1], 0.0, statespace.START_VAR[2], 99))}
    roster = players.select("player_id", "position")
    state = roster.select("*", *(F.lit(v).alias(k) for k, v in start.items())) if before is None else remap_state(before.drop("position"), roster, start)
    mine = rated.where("situation = 'overall' and col like 'p:%'").select(F.substring("col", 3, 200).alias("player_id"), F.col("rating").alias("y"))
    obs = roster.select("player_id").join(mine, "player_id", "left").select("player_id", F.coalesce("y", F.lit(0.0)).alias("y"), F.lit(1.0).alias("snaps"))
    found = statespace.changepoints(state, obs).select("player_id")
    mark = lambda df, name: df.select("player_id").distinct().withColumn(name, F.lit(True))
    obs = obs.join(mark(events.unionByName(found), "event"), "player_id", "left").join(mark(reset, "reset"), "player_id", "left")
    return statespace.step(state, obs)


def grades(rated: DataFrame) -> DataFrame:
    """(situation, team, position, grade): what a defence gives up, the same for four positions."""
    d = rated.where("col like 'd:%'").select("situation", F.substring("col", 3, 200).alias("team"), (-F.col("rating")).alias("grade"))
    return d.select("situation", "team", F.explode(F.array(*map(F.lit, SKILL))).alias("position"), "grade")


def _slot(text: str | None) -> tuple[int, int] | None:
    return tuple(int(x) for x in text.split("-")) if text else None


def weekly_update(store: Store, season: int, week: int, valued: DataFrame, players: DataFrame, market: DataFrame | None = None, interventions: DataFrame | None = None, coaching: DataFrame | None = None) -> dict:
    """Enter a week's valued plays, and all that follows from them, in one commit.

    ``market``: (team, strength); ``interventions``: (player_id, season, week); ``coaching``:
    (team, role, season, week). Grades are for the week after. Returns a report.
    """
    spark = store.spark
    none = spark.createDataFrame([], "player_id string, season int, week int")
    at = lambda df, s, w: df.where((F.col("season") == s) & (F.col("week") == w))
    plays = at(valued, season, week)
    blocks, _ = written(week_blocks(plays, players))  # once, however often the commit is tried
    if blocks.isEmpty():
        return {"season": season, "week": week, "entered": False, "slots": []}

    def work(tx: Transaction) -> dict:
        mark = _slot(tx.meta(MARK))
        tx.replace("blocks", blocks, [(season, week)])
        slots = sorted(tuple(map(int, p)) for p in tx.parts("blocks"))
        redo = [s for s in slots if s >= (season, week)]
        before = max((tuple(map(int, p)) for p in tx.parts("filter_state") if tuple(map(int, p)) < (season, week)), default=None)
        for s, w in redo:
            rated, _ = written(ratings(tx.read("blocks", [p for p in slots if p <= (s, w)]), market))
            now = {"season": F.lit(s), "week": F.lit(w)}
            tx.replace("ratings", rated.withColumns(now), [(s, w)])
            events = at(interventions if interventions is not None else none, s, w).select("player_id")
            reset = resets(players, coaching, s, w) if coaching is not None else none.select("player_id")
            state, _ = written(next_state(tx.read("filter_state", [before]) if before else None, rated, players, events, reset))
            tx.replace("filter_state", state.withColumns(now), [(s, w)])
            total = F.col("x0") + F.col("x1") + F.col("x2")
            tx.replace("trajectory", state.select("player_id", F.lit(s).alias("season"), F.lit(w).alias("week"), F.col("x0").alias("talent"), F.col("x1").alias("form"), total.alias("total"), "var"), [(s, w)])
            tx.replace("grades", grades(rated).withColumns({"season": F.lit(s), "week": F.lit(w + 1)}), [(s, w + 1)])
            before = (s, w)
        top = max(filter(None, (mark, (season, week))))
        tx.set_meta(MARK, f"{top[0]}-{top[1]}")
        return {"season": season, "week": week, "entered": True, "correction": mark is not None and (season, week) <= mark, "slots": redo}

    return store.log.transact(work)
