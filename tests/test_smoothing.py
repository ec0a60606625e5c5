"""Filter and smoothers as folds, against matrices."""

from dataclasses import astuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import statespace

COLS = "player_id string, position string, season int, week int, y double, snaps double, played boolean, event boolean"


def forward(obs, p, start_of):
    """Filtered means and covariances, and the aged covariance of every week."""
    f, h = np.diag([1.0, p.phi, p.phi_scheme]), np.ones(3)
    ys = [o[0] for o in start_of[:3] if o[0] is not None]
    x, c, games, out = np.array([np.mean(ys) if ys else 0.0, 0, 0]), np.diag([0.05, 0.02, 0.01]), 99, []
    for y, snaps, played, event in obs:
        x, c = f @ x, f @ c @ f.T
        c = c.copy()
        c[0, 0] /= p.d_spike if event else p.d_steady
        c[1, 1] += p.q_form * (6 if event else 1)
        c[2, 2] += p.q_scheme + (p.scheme_reset_var if event else 0)
        games, aged = (0 if event else games), (x.copy(), c.copy())
        r = (2.0 if games < 2 else 1.0) * p.r_scale / max(snaps, 1)
        if played and y is not None:
            k = c @ h / (h @ c @ h + r)
            x = x + k * (y - h @ x)
            a = np.eye(3) - np.outer(k, h)
            c = a @ c @ a.T + np.outer(k, k) * r
            games += 1
        out.append((x, c, *aged))
    return out


def smooth(obs, p):
    """By the textbook: each week corrected by how far the next one moved."""
    f = np.diag([1.0, p.phi, p.phi_scheme])
    run = forward(obs, p, obs)
    at = [run[-1][:2]]
    for (x, c, *_), (_, _, mean, aged) in zip(run[-2::-1], run[:0:-1]):
        spread = aged + 1e-10 * np.eye(3)
        gain = c @ f @ np.linalg.inv(spread)
        later_x, later_c = at[-1]
        at.append((x + gain @ (later_x - mean), c + gain @ (later_c - spread) @ gain.T))
    return at[::-1]


@pytest.fixture(scope="module")
def weeks(spark):
    rng = np.random.default_rng(4)
    by = {}
    for i, pos in enumerate(["QB", "RB", "WR", "TE", "K", "WR", "WR"]):
        n = (14, 14, 40, 3, 2, 1, 9)[i]
        obs = [(float(rng.normal()), float(rng.integers(0, 40)), True, w in (4, 9)) for w in range(n)]
        by[f"x{i}", pos] = [(None, s, False, e) if w in (0, 7, 8) and i % 2 else (y, s, pl, e) for w, (y, s, pl, e) in enumerate(obs)]
    by["none", "RB"] = [(None, 0.0, False, False)] * 5
    rows = [(*k, 2020 + w // 10, w % 10 + 1, *o) for k, v in by.items() for w, o in enumerate(v)]
    return by, spark.createDataFrame(rows, COLS)


def got(df):
    out = {}
    for r in df.orderBy("player_id", "season", "week").collect():
        out.setdefault(r.player_id, []).append((r.talent, r.total, r.var_talent))
    return out


def test_smoother_equals_matrices(weeks):
    by, df = weeks
    have = got(statespace.smoothed(df))
    assert have.keys() == {k for k, _ in by}
    for (who, pos), obs in by.items():
        want = [(x[0], x.sum(), c[0, 0]) for x, c in smooth(obs, statespace.Params.of(pos))]
        assert np.allclose(have[who], want, atol=1e-9, rtol=0)
    plan = statespace.smoothed(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("lag", [0, 1, 2, 5])
def test_fixed_lag_is_smoothing_of_what_was_known(weeks, lag):
    by, df = weeks
    have = got(statespace.fixed_lag(df, lag))
    for (who, pos), obs in by.items():
        want = []
        for t in range(len(obs)):
            x, c = smooth(obs[: t + lag + 1], statespace.Params.of(pos))[t]
            want.append((x[0], x.sum(), c[0, 0]))
        assert np.allclose(have[who], want, atol=1e-9, rtol=0)


def test_step_and_changepoints_equal_matrices(spark):
    rng = np.random.default_rng(3)
    state, obs, want, flagged = [], [], {}, set()
    for i in range(24):
        pos = ["QB", "RB", "WR", "K"][i % 4]
        p = statespace.Params.of(pos)
        x = rng.normal(size=3) * 0.2
        m = rng.normal(size=(3, 3)) * 0.1
        c = m @ m.T + 0.02 * np.eye(3)
        y = None if i % 7 == 3 else float(x.sum() + rng.normal() * (4 if i % 5 == 0 else 0.2))
        snaps, event, reset = float(rng.integers(0, 30)), i % 6 == 1, i % 8 == 2
        state.append((f"x{i}", pos, *x.tolist(), *c[np.triu_indices(3)].tolist(), 5))
        if i % 9:
            obs.append((f"x{i}", y, snaps, event, reset))
        else:
            y, snaps, event, reset = None, 1.0, False, False

        def one(event, reset, p=p, x=x, c=c, y=y, snaps=snaps):
            f, h = np.diag([1.0, p.phi, p.phi_scheme]), np.ones(3)
            a, b = f @ x, f @ c @ f.T
            b[0, 0] /= p.d_spike if event else p.d_steady
            b[1, 1] += p.q_form * (6 if event else 1)
            b[2, 2] += p.q_scheme + (p.scheme_reset_var if event else 0)
            if reset:
                a[2], b[2, :], b[:, 2] = 0, 0, 0
                b[2, 2] = p.scheme_reset_var
            r = (2.0 if event else 1.0) * p.r_scale / max(snaps, 1)
            pred, var = a.sum(), h @ b @ h + r
            if y is not None:
                k = b @ h / var
                a, b = a + k * (y - pred), (np.eye(3) - np.outer(k, h)) @ b
            return a, b, pred, var

        want[f"x{i}"] = one(event, reset)
        _, _, pred, var = one(False, False)
        if y is not None and i % 9 and abs(y - pred) / np.sqrt(var) > 3:
            flagged.add(f"x{i}")
    s = spark.createDataFrame(state, "player_id string, position string, " + ", ".join(f"{k} double" for k in statespace.STATE[:-1]) + ", games int")
    o = spark.createDataFrame(obs, "player_id string, y double, snaps double, event boolean, reset boolean")
    rows = {r.player_id: r for r in statespace.step(s, o).collect()}
    assert rows.keys() == want.keys()
    for k, (a, b, pred, var) in want.items():
        r = rows[k]
        assert [r.x0, r.x1, r.x2, r.p00, r.p01, r.p02, r.p11, r.p12, r.p22, r.pred, r["var"]] == pytest.approx([*a, *b[np.triu_indices(3)], pred, var], abs=1e-10)
        assert r.games == 5 * (not any(x[0] == k and x[3] for x in obs)) + any(x[0] == k and x[1] is not None for x in obs)
    assert {r.player_id for r in statespace.changepoints(s, o).collect()} == flagged and 2 <= len(flagged) < 12
    assert len(astuple(statespace.Params())) == 10


def test_frozen_talent_is_the_smoothers_last_week_before_the_origin(spark, sf):
    from tallyfield.plans import forecasts, models

    past = models.series(spark, sf).where(forecasts.AT.outcome).collect()
    by = {}
    for r in sorted(past, key=lambda r: (r.season, r.week)):
        by.setdefault((r.player_id, r.position), []).append((r.y, float(r.snaps), r.played, r.event))
    have = {r.player_id: r.talent for r in forecasts.m25_frozen_talent(spark, sf).collect()}
    assert have.keys() == {k for k, _ in by} and len(have) > 10
    for (who, pos), obs in by.items():
        assert have[who] == pytest.approx(smooth(obs, statespace.Params.of(pos))[-1][0][0], abs=1e-9)
