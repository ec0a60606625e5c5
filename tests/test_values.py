"""Values of the queries that SQL can't say, recomputed from their inputs."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield import views
from tallyfield.operators import attribution, ingest, projection, statespace
from tallyfield.plans import models, more


@pytest.fixture(scope="module")
def valued(spark, sf):
    return models.valued(spark, sf).persist()


def test_m7_one_system_a_situation(spark, sf, valued):
    plays = ingest.situations(valued).persist()
    sizes = Counter(r.situation for r in plays.select("situation").collect())
    got = defaultdict(dict)
    for r in models.m7_situation_ratings(spark, sf).collect():
        got[r.situation][r.col] = r.rating
    assert set(got) == {s for s, n in sizes.items() if n >= 200} and len(got) >= 2
    for name in got:
        mine = plays.where(F.col("situation") == name).drop("situation")
        want = attribution.solve_ridge(attribution.gram_blocks(attribution.design(mine, views.players(spark, sf)), mine, []))
        assert got[name] == pytest.approx(want, abs=1e-8)


def test_d8_grades_are_what_defences_give_up(spark, sf, valued):
    beta = attribution.solve_ridge(attribution.gram_blocks(attribution.design(valued, views.players(spark, sf)), valued, []))
    want = {(k[2:], p): -b for k, b in beta.items() if k.startswith("d:") for p in ("QB", "RB", "WR", "TE")}
    assert {(r.team, r.position): r.grade for r in more.d8_matchup_grades(spark, sf).collect()} == pytest.approx(want, abs=1e-8)


def rate_rows(spark, sf):
    return [r.asDict() for r in models.rate_frame(spark, sf).collect()]


def ridge(rows, position, driver, stat):
    """Standardised by the population spread, penalty 1, players without volume left out."""
    use = [r for r in rows if r["position"] == position and (r[driver] or 0) > 0]
    x = np.array([[r[f] or 0.0 for f in projection.FEATURES] for r in use], float)
    y = np.array([r[stat] / r[driver] for r in use], float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + np.eye(len(mean)), z.T @ (y - y.mean())) / sd
    return w, y.mean() - w @ mean


def test_m20_rates_equal_a_ridge_on_the_rows(spark, sf):
    rows = rate_rows(spark, sf)
    got = {(r.position, r.driver, r.stat): r for r in models.m20_rate_models(spark, sf).collect()}
    want = {(p, d, s) for p in {r["position"] for r in rows} for d, ss in projection.RATES.items() for s in ss if any(r["position"] == p and (r[d] or 0) > 0 for r in rows)}
    assert got.keys() == want and len(want) > 20
    for key, r in got.items():
        w, b = ridge(rows, *key)
        assert [r.w_rating, r.w_talent, r.w_prior, r.intercept] == pytest.approx([*w, b], abs=1e-7)


def test_m21_lines_are_volume_times_rate(spark, sf):
    rows = rate_rows(spark, sf)
    fits = {}
    volume = {r.player_id: r for r in projection.volume(views.player_stats(spark, sf), models.AT).collect()}
    features = {r["player_id"]: [r[f] or 0.0 for f in projection.FEATURES] for r in rows}
    got = {r.player_id: r for r in models.m21_stat_lines(spark, sf).collect()}
    assert got.keys() == {p for p in volume if p in features} and len(got) > 8
    for p, r in got.items():
        for d, stats in projection.RATES.items():
            assert r[d] == pytest.approx(17 * volume[p][d])
            for s in stats:
                key = (r.position, d, s)
                if key not in fits:
                    fits[key] = ridge(rows, *key) if any(x["position"] == r.position and (x[d] or 0) > 0 for x in rows) else (np.zeros(3), 0.0)
                w, b = fits[key]
                assert r[s] == pytest.approx(17 * max(volume[p][d] * (w @ features[p] + b), 0.0), abs=1e-6)


def test_qy12_joins_the_last_filtered_state(spark, sf):
    last = {}
    for r in statespace.filtered(models.series(spark, sf)).collect():
        if r.player_id not in last or (r.season, r.week) > last[r.player_id][0]:
            last[r.player_id] = ((r.season, r.week), r.x0, r["var"])
    targets = defaultdict(list)
    for r in views.player_stats(spark, sf).collect():
        targets[r.player_id].append(r.targets)
    got = {r.player_id: r for r in more.qy12_player_ratings(spark, sf).collect()}
    assert got.keys() == last.keys() | targets.keys()
    for p, r in got.items():
        assert (r.talent, r.pred_var, r.targets_pg) == pytest.approx((last[p][1], last[p][2], np.mean(targets[p])))
