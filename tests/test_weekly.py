"""The weekly chain: by brute force, killed between any two steps, in any order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import attribution, statespace, weekly
from tallyfield.sources import store as st

TABLES = ("blocks", "ratings", "filter_state", "trajectory", "grades")
COLS = "drive_id string, play_id long, season int, week int, off_team string, def_team string, down int, ydstogo int, yardline_100 int, clock int, off_players array<string>, def_players array<string>, dv double"


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(8)
    rows = []
    for season, week in ((2022, 17), (2023, 1), (2023, 2), (2023, 3)):
        for k in range(240):
            side = k % 2
            off, dfn = ("a", "b") if side else ("b", "a")
            rows.append((f"{season}-{week}-{k // 6}", k, season, week, off, dfn, k % 4 + 1, int(rng.integers(1, 12)), int(rng.integers(1, 40)), 500,
                         [f"{off}q", f"{off}w{rng.integers(0, 3)}"], [f"{dfn}d{rng.integers(0, 3)}"], float(rng.normal() + (week == 2) * side)))
    plays = spark.createDataFrame(rows, COLS).persist()
    people = [(f"{t}{x}", t, p) for t in "ab" for x, p in (("q", "QB"), ("w0", "WR"), ("w1", "WR"), ("w2", "TE"), ("d0", "DEF"), ("d1", "DEF"), ("d2", "DEF"))] + [("bench", "a", "RB")]
    return plays, spark.createDataFrame(people, "player_id string, team string, position string").persist()


def opened(spark, at):
    s = st.Store(spark, str(at))
    s.init()
    return s


def contents(store):
    out = {}
    for t in TABLES:
        df = store.read(t)
        for r in df.collect():
            v = r.asDict()
            key = tuple(v.pop(c) for c in list(v) if c in ("player_id", "season", "week", "situation", "i", "j", "col", "team", "position"))
            out[(t, *key)] = tuple(v.values())
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9), k


@pytest.fixture(scope="module")
def whole(spark, log, tmp_path_factory):
    """All weeks in order."""
    plays, players = log
    s = opened(spark, tmp_path_factory.mktemp("whole"))
    market = spark.createDataFrame([("a", 0.2), ("b", -0.1)], "team string, strength double")
    told = spark.createDataFrame([("aq", 2023, 2)], "player_id string, season int, week int")
    coach = spark.createDataFrame([("b", "OC", 2023, 2), ("a", "DC", 2023, 3)], "team string, role string, season int, week int")
    more = dict(market=market, interventions=told, coaching=coach)
    for season, week in ((2022, 17), (2023, 1), (2023, 2), (2023, 3)):
        r = weekly.weekly_update(s, season, week, plays, players, **more)
        assert r == {"season": season, "week": week, "entered": True, "correction": False, "slots": [(season, week)]}
    return s, contents(s), more


def test_tables_are_what_the_steps_give_by_hand(spark, log, whole):
    plays, players = log
    s, got, more = whole
    g = attribution.gram_blocks(attribution.design(plays, players), plays, []).unionByName(attribution.market_rows(more["market"]))
    beta = attribution.solve_ridge(g)
    have = {k[-1]: v[0] for k, v in got.items() if k[:3] == ("ratings", 2023, 3) and k[3] == "overall"}
    assert have == pytest.approx(beta, abs=1e-8)
    assert {k[3] for k in got if k[0] == "ratings"} > {"overall"} and s.meta(weekly.MARK) == "2023-3"
    state = None
    for season, week in ((2022, 17), (2023, 1), (2023, 2), (2023, 3)):
        now = {k[-1][2:]: v[0] for k, v in got.items() if k[:4] == ("ratings", season, week, "overall") and k[-1].startswith("p:")}
        rows = [(r.player_id, now.get(r.player_id, 0.0), 1.0) for r in players.collect()]
        obs = spark.createDataFrame(rows, "player_id string, y double, snaps double")
        if state is None:
            v = statespace.START_VAR
            state = players.select("player_id", "position", *(F.lit(x).alias(k) for k, x in zip(statespace.STATE, (0.0, 0.0, 0.0, v[0], 0.0, 0.0, v[1], 0.0, v[2], 99))))
        marked = {r.player_id for r in statespace.changepoints(state, obs).collect()} | ({"aq"} if (season, week) == (2023, 2) else set())
        team = {"bq", "bw0", "bw1", "bw2"} if (season, week) == (2023, 2) else {"ad0", "ad1", "ad2"} if (season, week) == (2023, 3) else set()
        full = [(*r, r[0] in marked, r[0] in team) for r in rows]
        state = spark.createDataFrame(statespace.step(state, spark.createDataFrame(full, "player_id string, y double, snaps double, event boolean, reset boolean")).collect())
        for r in state.collect():
            mine = got["trajectory", r.player_id, season, week]
            assert mine == pytest.approx((r.x0, r.x1, r.x0 + r.x1 + r.x2, r["var"]), abs=1e-8)
    for team in "ab":
        for position in ("QB", "RB", "WR", "TE"):
            assert got["grades", 2023, 4, "overall", team, position][0] == pytest.approx(-beta[f"d:{team}"], abs=1e-8)


@pytest.mark.parametrize("step", ["ratings", "next_state", "commit"])
def test_killed_between_steps_and_run_again(spark, log, whole, tmp_path, monkeypatch, step):
    plays, players = log
    _, want, more = whole
    s = opened(spark, tmp_path / "s")
    weekly.weekly_update(s, 2022, 17, plays, players, **more)
    before = contents(s)
    with monkeypatch.context() as m:
        def killed(*_a, **_k):
            raise SystemExit("killed")

        m.setattr(*((weekly, step) if step != "commit" else ("tallyfield.sources.commits.CommitLog.add",)), killed)
        with pytest.raises(SystemExit):
            weekly.weekly_update(s, 2023, 1, plays, players, **more)
    assert contents(s) == before and s.meta(weekly.MARK) == "2022-17"
    weekly.weekly_update(s, 2023, 1, plays, players, **more)
    slot = lambda k: next((k[i], k[i + 1]) for i in range(1, 5) if isinstance(k[i], int))
    early = {"grades": ((2022, 18), (2023, 2))}
    same(contents(s), {k: v for k, v in want.items() if slot(k) in early.get(k[0], ((2022, 17), (2023, 1)))})


def test_weeks_in_any_order_and_corrections_give_the_same(spark, log, whole, tmp_path):
    plays, players = log
    _, want, more = whole
    s = opened(spark, tmp_path / "s")
    wrong = plays.withColumn("dv", F.when((F.col("season") == 2023) & (F.col("week") == 1), F.col("dv") + 3).otherwise(F.col("dv")))
    assert weekly.weekly_update(s, 2023, 2, plays, players, **more)["slots"] == [(2023, 2)]
    assert weekly.weekly_update(s, 2023, 1, wrong, players, **more)["slots"] == [(2023, 1), (2023, 2)]
    assert weekly.weekly_update(s, 2023, 3, plays, players, **more)["correction"] is False
    r = weekly.weekly_update(s, 2022, 17, plays, players, **more)
    assert r["correction"] and r["slots"] == [(2022, 17), (2023, 1), (2023, 2), (2023, 3)]
    weekly.weekly_update(s, 2023, 1, plays, players, **more)  # corrected
    same(contents(s), want)
    assert s.meta(weekly.MARK) == "2023-3"
    assert weekly.weekly_update(s, 2024, 1, plays, players, **more) == {"season": 2024, "week": 1, "entered": False, "slots": []}
