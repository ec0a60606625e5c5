"""Gram blocks made in one pass over the states."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfield import views
from tallyfield.operators import attribution, ingest, state_sums
from tallyfield.plans import models, more
from tallyfield.session import batches_by_rows

PLAYS = "drive_id string, play_id long, season int, week int, off_team string, def_team string, down int, ydstogo int, yardline_100 int, drive_points int, off_players array<string>, def_players array<string>"


def odd_plays(spark):
    """Teams, ids and states that are null, ids that stand twice or on both sides, sides of unlike sizes."""
    rng = random.Random(3)
    ids = ["p0", "p1", "p2", "d0", "d1", "zz", None]
    rows = []
    for drive in range(60):
        points, season, week = rng.choice((0, 3, 7)), 2020 + drive % 2, 1 + drive % 3
        for play in range(rng.randint(1, 5)):
            side = lambda: [rng.choice(ids) for _ in range(rng.randint(0, 4))] if rng.random() < 0.95 else None
            rows.append((f"g{drive}", play, season, week, rng.choice("ABC"), rng.choice(("A", "B", None)), rng.randint(1, 4), rng.choice((1, 9, 60, None)), rng.choice((5, 47, 99, None)), points, side(), side()))
    rows.append(("only", 1, 2030, 1, "D", "E", 1, 5, None, 7, ["p0"], ["d0"]))  # a week without a value
    return spark.createDataFrame(rows, PLAYS)


@pytest.mark.parametrize("by", [[], ["season", "week"]])
@pytest.mark.parametrize("limits", [{}, {"DENSE": 0, "PLAYS": 7, "PRODUCTS": 40}, {"HELD": 20, "PLAYS": 7}])
def test_one_pass_gives_the_blocks_of_valued_plays(spark, monkeypatch, by, limits):
    s = ingest.with_next_state(odd_plays(spark)).persist()
    players = views.players(spark, "")
    want = {tuple(r[:-1]): r.v for r in attribution.play_gram(attribution.play_values(s, attribution.cell_values(s)), players, by).select(*by, "i", "j", "v").collect()}
    real = state_sums.added_up

    def limited(batches, by):
        from tallyfield.operators import state_sums

        before = {k: getattr(state_sums, k) for k in limits}
        try:
            for k, x in limits.items():
                setattr(state_sums, k, x)
            yield from real(batches, by)
        finally:  # the worker serves other tests
            for k, x in before.items():
                setattr(state_sums, k, x)

    monkeypatch.setattr(state_sums, "added_up", limited)
    g, strength = attribution.state_gram(s, players, by)
    got = {tuple(r[:-1]): r.v for r in g.select(*by, "i", "j", "v").collect()}
    assert got.keys() == want.keys() and len(got) > 40
    assert {k for k, x in got.items() if x is None} == {k for k, x in want.items() if x is None}
    assert {k: x for k, x in got.items() if x is not None} == pytest.approx({k: x for k, x in want.items() if x is not None}, abs=1e-9)
    mean = {r.off_team: r.m for r in s.groupBy("off_team").agg(F.avg("drive_points").alias("m")).collect()}
    assert {r.team: r.strength for r in strength.collect()} == pytest.approx(mean)
    if by:
        assert any(x is None for x in got.values())


def test_dealt_by_the_drives_number_states_are_the_same(spark, sf):
    want = ingest.with_next_state(views.plays(spark, sf))
    got = views.states(spark, sf)
    assert got.columns == want.columns and got.count() > 500
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_lists_without_blanks(spark):
    ids = [None, "", " ", ";", "a", "a;b", ";a", "a;", "a;;b", "a; ;b", " a;b", "a b", "a;b "]
    df = spark.createDataFrame([(x,) for x in ids], "x string")
    want = [[p for p in (x or "").split(";") if p.strip(" ")] for x in ids]
    assert [r.y for r in df.select(ingest.split_ids(F.col("x")).alias("y")).collect()] == want


@pytest.mark.parametrize("query", [more.d8_matchup_grades, models.e12_all_cumulative_blocks])
def test_line_items_are_read_once(spark, sf, monkeypatch, query):
    read, tables = views.read, []
    monkeypatch.setattr(views, "read", lambda s, d, name: tables.append(name) or read(s, d, name))
    out = query(spark, sf)
    assert tables.count("lineitem") == 1 and "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString()  # what is left reads the sums


def test_the_limit_of_bytes_comes_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    with pytest.raises(ValueError), batches_by_rows(spark):
        assert spark.conf.get(key) == str(2**31 - 1)
        raise ValueError
    assert spark.conf.get(key, None) == before
