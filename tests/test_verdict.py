"""The verdict over all origins, recomputed row by row."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield import views
from tallyfield.operators import verdict
from tallyfield.plans import models, systems


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(11)
    people = [(f"a{i}", "QB" if i < 12 else "WR") for i in range(24)] + [("k", "K")]
    skill = {p: rng.normal() for p, _ in people}
    slots = [(s, w) for s in (2021, 2022) for w in range(1, 7)]
    history = [(p, s, w, float(5 + 3 * skill[p] + rng.normal())) for p, _ in people for s, w in slots if rng.random() < 0.85]
    ratings = [(s, w, p, skill[p] + float(rng.normal()) * 0.1) for s, w in slots[4:] for p, _ in people if rng.random() < 0.9]
    return (
        ratings, history, dict(people), spark.createDataFrame(ratings, "season int, week int, player_id string, rating double"),
        spark.createDataFrame(history, "player_id string, season int, week int, points double"), spark.createDataFrame(people, "player_id string, position string"),
    )


def by_hand(ratings, history, position):
    """Margins of every (horizon, baseline, season, week, player)."""
    points = {(p, s, w): x for p, s, w, x in history}
    first = min((s, w) for s, w, _, _ in ratings)
    xy = defaultdict(list)
    at = {p: r for s, w, p, r in ratings if (s, w) == first}
    for (p, s, w), x in points.items():
        if (s, w) < first and p in at:
            xy[position[p]].append((at[p], x))
    maps = {q: np.polyfit(*zip(*v), 1) for q, v in xy.items() if len(v) >= 10 and len({a for a, _ in v}) > 1}
    out = {}
    for s, w, p, r in ratings:
        if position[p] not in maps:
            continue
        f = maps[position[p]][0] * r + maps[position[p]][1]
        of = lambda ok, season: [points[p, season, k] for k in range(1, 13) if (p, season, k) in points and ok(k)]  # noqa: B023, E731
        past = of(lambda k: k < w, s)  # noqa: B023
        real = {"weekly": of(lambda k: k == w, s), "rest_of_season": of(lambda k: k >= w, s)}  # noqa: B023
        base = {"persistence": past[-1:], "season_to_date": past, "last_season": of(lambda k: True, s - 1)}
        for h, a in real.items():
            for b, o in base.items():
                if a and o:
                    out[h, b, s, w, p] = abs(np.mean(o) - np.mean(a)) - abs(f - np.mean(a))
    return out


def test_report_by_hand(small):
    ratings, history, position, r, h, who = small
    want = by_hand(ratings, history, position)
    cells = verdict.paired(verdict.forecast.weekly_points(r.join(who, "player_id"), verdict.frozen_map(r, h, who)), h)
    got = {(x.horizon, x.baseline, x.season, x.week, x.player_id): x.margin for x in verdict.margins(cells).collect()}
    assert got.keys() == want.keys() and len(want) > 500
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    assert {k[4] for k in want}.isdisjoint({"k"})  # a position without a map is left out
    rows = {(x.horizon, x.baseline): x for x in verdict.run_verdict(r, h, who, 300).collect()}
    assert len(rows) == 6
    for key, x in rows.items():
        mine = {k: m for k, m in want.items() if k[:2] == key}
        assert x.n == len(mine) and x.point == pytest.approx(np.mean(list(mine.values()))) and x.baseline_mae - x.mae == pytest.approx(x.point)
        weeks = defaultdict(list)
        for k, m in mine.items():
            weeks[k[2:4]].append(m)
        sums = np.array([(sum(weeks[w]), len(weeks[w])) for w in sorted(weeks)])
        drawn = np.array([[int(hashlib.md5(f"boot|{rep}|{i}".encode()).hexdigest()[:12], 16) % len(sums) for i in range(len(sums))] for rep in range(300)])
        s, n = sums[drawn].sum(axis=1).T
        assert (x.lower, x.upper) == pytest.approx(np.quantile(s / n, (0.025, 0.975)))
        flips = [m * (1 if int(hashlib.md5("|".join([*key, k[4], str(k[2]), str(k[3])]).encode()).hexdigest()[:2], 16) % 2 == 0 else -1) for k, m in mine.items()]
        assert x.floor == pytest.approx(np.mean(flips) + 1.96 * np.std(flips, ddof=1) / math.sqrt(len(flips))) and x.passes == (x.point > x.floor)
    assert rows["rest_of_season", "last_season"].verdict == ("SHIP" if rows["rest_of_season", "last_season"].lower > 0 else "FALLBACK")
    assert [k for k, x in rows.items() if x.verdict] == [("rest_of_season", "last_season")]


def test_outcomes_to_come_change_no_forecast_and_none_is_inconclusive(small):
    _, _, _, r, h, who = small
    poisoned = h.withColumn("points", F.when(F.col("season") == 2022, F.col("points") + 1e6).otherwise(F.col("points")))
    m = lambda hist: sorted(map(tuple, verdict.frozen_map(r, hist, who).collect()))
    assert m(h) == m(poisoned)
    assert verdict.verdict(verdict.run_verdict(r, h.where("season = 2021"), who, 50)) == "INCONCLUSIVE"


def test_ratings_view_is_the_solved_system_with_its_metadata(spark, sf):
    from tallyfield.operators import attribution

    g = systems.system(spark, sf)
    scale = {x.col: x.factor for x in systems.position_scale(views.players(spark, sf)).collect()}
    beta = attribution.solve_ridge(g, scale=scale)
    credit = defaultdict(dict)
    for x in attribution.weekly_credit(attribution.context_residual(models.valued(spark, sf))).collect():
        credit[x.player_id][x.season, x.week] = (x.credit, x.snaps)
    people = {x.player_id: x for x in views.players(spark, sf).collect()}
    got = systems.qy12_fitted_ratings(spark, sf).collect()
    assert len(got) == sum(f"p:{p}" in beta for p in people)
    for x in got:
        assert (x.position, x.team) == (people[x.player_id].position, people[x.player_id].team)
        assert x.rating == pytest.approx(beta[f"p:{x.player_id}"], abs=1e-8)
        assert x.net_strength == pytest.approx(beta[f"o:{x.team}"] - beta[f"d:{x.team}"], abs=1e-8) and x.defence_grade == pytest.approx(-beta[f"d:{x.team}"], abs=1e-8)
        mine = credit.get(x.player_id)
        assert (x.last_credit, x.last_snaps) == (pytest.approx(mine[max(mine)][0], abs=1e-8), mine[max(mine)][1]) if mine else x.last_credit is None
