"""Properties of the operators on small fixtures."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield import views
from tallyfield.operators import asof, attribution, contract, evaluation, ingest, projection, statespace, valuation
from tallyfield.operators.asof import AsOf, LeakageError
from tallyfield.plans import models
from tallyfield.sources import sinks, tables

GAME = [
    ("g1", "g1_1", 1, 2023, 1, "A", "B", 1, 10, 75, "pass", "Touchdown", "p1;p2", "d1"),
    ("g1", "g1_1", 2, 2023, 1, "A", "B", 2, 4, 40, "run", "Touchdown", "p1;;p2", "d1"),
    ("g1", "g1_1", 3, 2023, 1, "A", "B", 1, 5, 5, "pass", "Touchdown", None, None),
    ("g1", "g1_2", 4, 2023, 1, "B", "A", 1, 10, 80, "run", "Punt", "p3", "d2"),
    ("g1", "g1_2", 5, 2023, 1, "B", "A", None, 7, 77, "no_play", "Punt", "p3", "d2"),
    ("g1", "g1_2", 6, 2023, 1, "B", "A", 4, 7, 77, "pass", "Punt", "p3", "d2"),
]
COLS = "game_id string, drive_id string, play_id long, season int, week int, off_team string, def_team string, down int, ydstogo int, yardline_100 int, play_type string, result string, offense_players string, defense_players string"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(GAME, COLS).withColumns({"yards": F.lit(0), "clock": F.lit(100)})


def test_adapter(spark, raw):
    s = {r.play_id: r for r in ingest.with_next_state(ingest.build_plays(raw)).collect()}
    assert sorted(s) == [1, 2, 3, 4, 6]
    assert (s[1].n_down, s[1].n_ydstogo, s[1].terminal) == (2, 4, False)
    assert (s[3].n_down, s[3].terminal, s[3].terminal_value) == (None, True, 7)
    assert s[6].terminal_value == 0 and s[4].n_down == 4
    assert s[2].off_players == ["p1", "p2"] and s[3].off_players == []


def test_unknown_result_is_an_error_when_corrected(raw):
    odd = raw.withColumn("result", F.lit("Meteor"))
    assert ingest.build_plays(odd).select(F.max("drive_points")).first()[0] == 0
    with pytest.raises(Exception, match="unknown drive result"):
        ingest.build_plays(odd, semantics="corrected").collect()


def test_contract_finds_planted_faults(spark, raw):
    good = ingest.with_next_state(ingest.build_plays(raw))
    universe = spark.createDataFrame([(x,) for x in ("p1", "p2", "p3", "d1", "d2")], "player_id string")
    assert contract.violations(good, universe).count() == 0
    bad = good.withColumn("n_down", F.when(F.col("play_id") == 1, 3).otherwise(F.col("n_down"))).withColumn("drive_points", F.when(F.col("play_id") == 4, 3).otherwise(F.col("drive_points")))
    rules = {r.rule for r in contract.violations(bad, universe.where("player_id <> 'd2'")).collect()}
    assert rules == {"r1_next_state", "r3_drive_points", "r6_unknown_player"}


def test_value_over_replacement(spark):
    pts = {"QB": [320, 290, 260], "RB": [280, 250, 200, 180, 150]}
    pool = spark.createDataFrame([(f"{p}{i}", p, float(x)) for p, xs in pts.items() for i, x in enumerate(xs)], "player_id string, position string, projected_points double")
    got = {r.player_id: r for r in valuation.value_over_replacement(pool, {"QB": 1, "RB": 2}, 2).collect()}
    assert got["QB0"].vor == 60 and got["RB0"].vor == 130 and got["RB0"].rank == 1


def test_tiers(spark):
    v = spark.createDataFrame([(str(i), float(x), i + 1) for i, x in enumerate([50, 48, 30, 28, 5])], "player_id string, vor double, rank int")
    assert [r.tier for r in valuation.tiers(v).orderBy("rank").collect()] == [1, 1, 2, 2, 3]


def greedy(roster, slots, out):
    need = {p: n for p, n in slots.items() if p != "FLEX"}
    flex, got = slots.get("FLEX", 0), set()
    for p in sorted(roster, key=lambda p: (-p[2], p[0])):
        if p[0] in out:
            continue
        if need.get(p[1], 0) > 0:
            need[p[1]] -= 1
            got.add(p[0])
        elif flex > 0 and p[1] in valuation.FLEX:
            flex -= 1
            got.add(p[0])
    return got


def test_lineup_equals_the_greedy_rule(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    slots = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "FLEX": 2}
    for k in range(60):
        r = [(f"x{i}", str(rng.choice(["QB", "RB", "WR", "TE", "K"])), float(rng.integers(0, 6))) for i in range(int(rng.integers(1, 16)))]
        out = {p[0] for p in r if rng.random() < 0.2}
        want[k] = greedy(r, slots, out)
        rows += [(k, *p, p[0] in out) for p in r]
    df = spark.createDataFrame(rows, "k int, player_id string, position string, projection double, is_out boolean")
    got = {k: set() for k in want}
    for r in valuation.lineup(df, slots, ["k"]).collect():
        got[r.k].add(r.player_id)
    assert got == want


def test_draft_fills_needs():
    pool = [{"player_id": f"{p}{i}", "position": p, "rank": 4 * i + j + 1} for j, p in enumerate(["QB", "RB", "WR", "TE"]) for i in range(12)]
    teams = valuation.draft(pool, {"QB": 1, "RB": 2, "FLEX": 1}, 4, 6)
    assert len({p["player_id"] for t in teams for p in t}) == 24
    assert all(sum(p["position"] == "RB" for p in t[:4]) >= 2 for t in teams)


def test_draft_equals_a_plain_search(spark):
    rng = np.random.default_rng(7)
    slots, teams, rounds = {"QB": 1, "RB": 2, "WR": 1, "FLEX": 1}, 5, 7
    for trial in range(4):
        pool = [{"player_id": f"x{i}", "position": str(rng.choice(["QB", "RB", "WR", "TE", "K"])), "rank": int(r) + 1} for i, r in enumerate(rng.permutation(60))]
        left, rosters = sorted(pool, key=lambda p: p["rank"]), [[] for _ in range(teams)]
        opened = [dict(slots) for _ in range(teams)]
        for k in range(teams * rounds):
            t = k % teams if (k // teams) % 2 == 0 else teams - 1 - k % teams
            where = lambda p, t=t: p["position"] if opened[t].get(p["position"]) else "FLEX" if p["position"] in ("RB", "WR", "TE") and opened[t]["FLEX"] else None
            wanted = [p for p in left if where(p)] or left
            if where(wanted[0]):
                opened[t][where(wanted[0])] -= 1
            rosters[t].append(wanted[0])
            left.remove(wanted[0])
        df = spark.createDataFrame([(p["player_id"], p["position"], p["rank"], 0) for p in pool], "player_id string, position string, rank int, f int")
        near = [r.asDict() for r in valuation.within_reach(df, teams * rounds, ["f"]).select("player_id", "position", "rank").collect()]
        assert valuation.draft(near, slots, teams, rounds) == rosters


def test_play_gram_equals_the_triplets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        off = [f"p{x}" for x in rng.integers(0, 9, 3)]  # repeats, and p8 is unknown
        dfn = [f"p{x}" for x in rng.integers(0, 9, 2)]
        rows.append((f"d{k // 6}", k, 2020 + k % 2, 1 + k % 3, "a", "b" if k % 4 else "a", off, dfn, float(rng.normal())))
    plays = spark.createDataFrame(rows, "drive_id string, play_id long, season int, week int, off_team string, def_team string, off_players array<string>, def_players array<string>, dv double")
    players = spark.createDataFrame([(f"p{x}",) for x in range(8)], "player_id string")
    for by in (None, [], ["season"]):
        keys = ["season", "week"] if by is None else by
        t = attribution.design(plays, players)
        want = {tuple(r[c] for c in [*keys, "i", "j"]): r.v for r in attribution.gram_blocks(t, plays, by).collect()}
        got = {tuple(r[c] for c in [*keys, "i", "j"]): r.v for r in attribution.play_gram(plays, players, by).collect()}
        assert got == pytest.approx({k: x for k, x in want.items() if k in got}) and all(abs(x) < 1e-12 for k, x in want.items() if k not in got) and set(got) <= set(want) | {k for k, x in got.items() if abs(x) < 1e-12}


def test_ratings_equal_least_squares_on_explicit_rows(spark):
    """Market pseudo-rows, a prior mean and penalties by column against the stacked system."""
    rng = np.random.default_rng(5)
    cols = ["d:a", "d:b", "o:a", "o:b", "p:x", "p:y"]
    x = rng.integers(-1, 2, (80, 6)).astype(float)
    y = rng.normal(size=80)
    market, strength, w = np.array([[1, 0, 1, 0, 0, 0], [0, 1, 0, 1, 0, 0]], float), np.array([0.3, -0.2]), 40.0
    sums = {}
    for a in range(6):
        sums[cols[a], None] = float(x[:, a] @ y)
        for b in range(a, 6):
            sums[cols[a], cols[b]] = float(x[:, a] @ x[:, b])
    s = spark.createDataFrame([("a", 0.3), ("b", -0.2)], "team string, strength double")
    for r in attribution.market_rows(s, w).collect():
        sums[r.i, r.j] = sums.get((r.i, r.j), 0.0) + r.v
    scale, prior = {"p:x": 2.0}, {"p:x": 0.7}
    got = attribution.solve_system(sums, 5.0, prior, scale)
    pen = 5.0 * np.array([0.05, 0.05, 0.05, 0.05, 2.0, 1.0])
    mean = np.array([0, 0, 0, 0, 0.7, 0])
    big = np.vstack([x, np.sqrt(w) * market, np.diag(np.sqrt(pen))])
    want = np.linalg.lstsq(big, np.concatenate([y, np.sqrt(w) * strength, np.sqrt(pen) * mean]), rcond=None)[0]
    assert [got[c] for c in cols] == pytest.approx(want.tolist())
    assert attribution.solve_system({("p:x", "p:x"): 1e12, ("p:y", "p:y"): 1e-6}, 1e-9)["p:x"] == 0.0


def test_asof_guards(spark):
    h = spark.createDataFrame([(2022, 9), (2023, 1), (2023, 5), (2024, 1)], "season int, week int")
    at = AsOf(2023, 5)
    assert at.slice_plays(h).count() == 2 and h.where(at.pregame).count() == 3
    with pytest.raises(LeakageError):
        at.assert_clean(h)
    with pytest.raises(LeakageError):
        at.slice_interventions(h.drop("season"))
    with pytest.raises(ValueError):
        AsOf(2023, 0)


def test_future_does_not_reach_a_forecast(spark, sf):
    h = views.history(spark, sf)
    at = AsOf(2023, 5)
    poisoned = h.withColumn("points", F.when(at.outcome, F.col("points")).otherwise(1e6))
    for f in (asof.persistence, asof.season_to_date, asof.recency_mean):
        assert sorted(f(h, at).collect()) == sorted(f(poisoned, at).collect())


def test_gram_equals_dense_product_and_adds_up(spark):
    plays, players = tables.synthetic_world(spark, teams=4, weeks=3, drives=3)
    plays = plays.persist()
    t = attribution.design(plays, players).persist()
    names = sorted(r.col for r in t.select("col").distinct().collect())
    keys = {(r.drive_id, r.play_id): (i, r.dv) for i, r in enumerate(plays.collect())}
    x = np.zeros((len(keys), len(names)))
    for r in t.collect():
        x[keys[r.drive_id, r.play_id][0], names.index(r.col)] = r.val
    y = np.array([dv for _, dv in keys.values()])
    g = attribution.gram_blocks(t, plays, [])
    a, b = np.zeros((len(names),) * 2), np.zeros(len(names))
    for r in g.collect():
        if r.j is None:
            b[names.index(r.i)] = r.v
        else:
            a[names.index(r.i), names.index(r.j)] = a[names.index(r.j), names.index(r.i)] = r.v
    assert np.allclose(a, x.T @ x) and np.allclose(b, x.T @ y)
    blocks = attribution.gram_blocks(t, plays).groupBy("i", "j").agg(F.sum("v").alias("v"))
    assert np.isclose(blocks.agg(F.sum("v")).first()[0], g.agg(F.sum("v")).first()[0])
    beta = attribution.solve_ridge(g, lam=5.0)
    pen = 5.0 * np.array([1.0 if n.startswith("p:") else 0.05 for n in names])
    m = a + np.diag(pen)
    assert np.linalg.norm(m @ np.array([beta[n] for n in names]) - b) / np.linalg.norm(b) < 1e-9


def test_all_cumulative_blocks_by_brute_force(spark, sf):
    plays = views.plays(spark, sf)
    dv = {(r.drive_id, r.play_id): r.dv for r in models.valued(spark, sf).select("drive_id", "play_id", "dv").collect()}
    per_play = defaultdict(dict)
    known = {r.player_id for r in views.players(spark, sf).collect()}
    for r in plays.collect():
        x = per_play[r.season, r.week, r.drive_id, r.play_id]
        for col, val in [*(("p:" + p, 1.0) for p in r.off_players if p in known), *(("p:" + p, -1.0) for p in r.def_players if p in known), ("o:" + r.off_team, 1.0), ("d:" + r.def_team, -1.0)]:
            x[col] = x.get(col, 0.0) + val
    blocks = defaultdict(dict)
    for (season, week, drive, play), x in per_play.items():
        for i, a in x.items():
            for j, b in [*((j, b) for j, b in x.items() if i <= j), (None, dv[drive, play])]:
                at = blocks[i, j]
                at[season, week] = at.get((season, week), 0.0) + a * b
    want = {}
    for (i, j), at in blocks.items():
        before = 0.0
        for k, slot in enumerate(sorted(at)):
            if k:
                want[(*slot, i, j)] = before
            before += at[slot]
    got = {(r.season, r.week, r.i, r.j): r.v for r in models.e12_all_cumulative_blocks(spark, sf).collect()}
    assert got.keys() == want.keys() and {k[2][0] for k in got} == {"p", "o", "d"} and any(k[3] is None for k in got)
    assert max(abs(got[k] - want[k]) for k in got) < 1e-5


def test_walk_forward_has_every_origin_and_looks_only_back(spark, sf):
    got = defaultdict(dict)
    for r in models.e12_walk_forward(spark, sf).collect():
        got[r.season, r.week][r.col] = r.rating
    s = models.states(spark, sf).persist()
    players = views.players(spark, sf)
    slots = sorted((r.season, r.week) for r in s.select("season", "week").distinct().collect())
    assert len(slots) > 70 and sorted(got) == slots[4:]

    # one origin from its own plays alone: values of the first four slots, one ridge solve
    number = F.col("season") * 100 + F.col("week")
    season, week = slots[40]
    early = s.where(number < season * 100 + week)
    first = s.where(number < slots[4][0] * 100 + slots[4][1]).collect()
    bucket = lambda d, togo, line: (d, min(togo // 5, 9), line // 10)
    cell = defaultdict(list)
    for r in first:
        cell[bucket(r.down, r.ydstogo, r.yardline_100)].append(r.drive_points)
    mean = sum(r.drive_points for r in first) / len(first)
    value = lambda *x: np.mean(cell[x]) if x in cell else mean
    dv = []
    for r in early.collect():
        v0 = value(*bucket(r.down, r.ydstogo, r.yardline_100))
        v1 = r.terminal_value if r.terminal else value(*bucket(r.n_down, r.n_ydstogo, r.n_yardline_100)) if r.n_down is not None else v0
        dv.append((r.drive_id, r.play_id, float(v1 - v0)))
    target = spark.createDataFrame(dv, "drive_id string, play_id long, dv double")
    want = attribution.solve_ridge(attribution.gram_blocks(attribution.design(early, players), target, []))
    assert want.keys() == got[season, week].keys()
    assert max(abs(want[k] - got[season, week][k]) for k in want) < 1e-8

    few = s.where(number <= slots[9][0] * 100 + slots[9][1])
    assert list(evaluation.walk_forward(few, players, warmup_weeks=5, origin_stride=2)) == slots[5:10:2]
    with pytest.raises(ValueError, match="no origin"):
        evaluation.walk_forward(few, players, warmup_weeks=10)
    s.unpersist()


def test_boosted_query_asks_for_300_rounds(spark, sf, monkeypatch):
    asked, fit = [], attribution.fit_boosted_value
    monkeypatch.setattr(attribution, "fit_boosted_value", lambda s, rounds=40: asked.append(rounds) or fit(s, 1))
    assert models.m1_boosted_values(spark, sf).count() == 4 and asked == [300]


def test_bootstrap_of_10000_replicates_by_brute_force(spark, sf):
    u = models.cells(spark, sf).select("week", (F.abs(F.col("baseline") - F.col("actual")) - F.abs(F.col("forecast") - F.col("actual"))).alias("m"))
    weeks = defaultdict(list)
    for r in u.collect():
        weeks[r.week].append(r.m)
    sums = np.array([(sum(weeks[w]), len(weeks[w])) for w in sorted(weeks)])
    size = len(sums)
    drawn = np.array([[int(hashlib.md5(f"boot|{rep}|{i}".encode()).hexdigest()[:12], 16) % size for i in range(size)] for rep in range(10_000)])
    s, n = sums[drawn].sum(axis=1).T
    got = models.e10_cluster_bootstrap_10000(spark, sf).first()
    assert np.allclose((got.lower, got.upper), np.quantile(s / n, (0.025, 0.975)), atol=1e-7) and got.clusters == size


def test_planted_abilities_are_recovered(spark):
    corr = []
    for seed in (1, 2, 3):
        plays, players = tables.synthetic_world(spark, teams=6, weeks=10, drives=10, seed=seed)
        beta = attribution.solve_ridge(attribution.gram_blocks(attribution.design(plays, players), plays, []), lam=20.0)
        true = {r.player_id: r.ability for r in players.collect()}
        pairs = [(beta[f"p:{p}"], a) for p, a in true.items() if f"p:{p}" in beta]
        corr.append(np.corrcoef(*zip(*pairs))[0, 1])
    assert np.median(corr) > 0.6


def test_week_blocks_are_replaced_not_added(spark, tmp_path):
    plays, players = tables.synthetic_world(spark, teams=4, weeks=2, drives=3)
    at = str(tmp_path / "blocks")
    attribution.weekly_update(spark, plays, players, at)
    again = attribution.weekly_update(spark, plays.where("week = 2"), players, at)
    want = attribution.gram_blocks(attribution.design(plays, players), plays)
    assert again.count() == want.count()
    assert np.isclose(again.agg(F.sum("v")).first()[0], want.agg(F.sum("v")).first()[0])


def batch_filter(y, snaps, played, events, p, x0):
    f, h = np.diag([1.0, p.phi, p.phi_scheme]), np.ones(3)
    x, c, games, out = np.array([x0, 0.0, 0.0]), np.diag([0.05, 0.02, 0.01]), 99, []
    for w in range(len(y)):
        x, c = f @ x, f @ c @ f.T
        c[0, 0] /= p.d_spike if events[w] else p.d_steady
        c[1, 1] += p.q_form * (6 if events[w] else 1)
        c[2, 2] += p.q_scheme + (p.scheme_reset_var if events[w] else 0)
        games = 0 if events[w] else games
        r = (2.0 if games < 2 else 1.0) * p.r_scale / max(snaps[w], 1)
        s, pred = h @ c @ h + r, h @ x
        if played[w]:
            k = c @ h / s
            x = x + k * (y[w] - pred)
            a = np.eye(3) - np.outer(k, h)
            c = a @ c @ a.T + np.outer(k, k) * r
            games += 1
        out.append((x[0], x.sum(), pred, s))
    return np.array(out)


def test_fold_equals_the_matrix_filter(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i, pos in enumerate(["QB", "RB", "WR", "K"]):
        y, snaps = rng.normal(size=14), rng.integers(0, 40, 14)
        played = np.ones(14, bool)
        played[7:9] = False
        events = np.arange(14) == 9
        want[f"x{i}"] = batch_filter(y, snaps, played, events, statespace.Params.of(pos), y[:3].mean())
        rows += [(f"x{i}", pos, 2023, w + 1, float(y[w]) if played[w] else None, float(snaps[w]), bool(played[w]), bool(events[w])) for w in range(14)]
    s = spark.createDataFrame(rows, "player_id string, position string, season int, week int, y double, snaps double, played boolean, event boolean")
    got = {}
    for r in statespace.filtered(s).orderBy("player_id", "week").collect():
        got.setdefault(r.player_id, []).append((r.x0, r.x0 + r.x1 + r.x2, r.pred, r["var"]))
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-10)
    smooth = statespace.smoothed(s)
    assert smooth.count() == 56 and smooth.where("var_talent < 0").isEmpty()


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 2.0), ("c", 3.0, 5.0), ("d", 4.0, 4.0)], "k string, p double, a double").withColumn("g", F.lit(1))
    p, a = F.col("p"), F.col("a")
    r = df.agg(evaluation.mae(p, a).alias("m"), evaluation.bias(p, a).alias("b"), evaluation.rmse(p, a).alias("r")).first()
    assert (r.m, r.b, round(r.r, 6)) == (0.75, -0.75, round((5 / 4) ** 0.5, 6))
    assert evaluation.top_n_hits(df, "p", "a", 2, ["g"], "k").first().hit_rate == 1.0


def test_normal_functions(spark):
    from tallyfield.functions import normal

    z = spark.range(-40, 41).select((F.col("id") / 10).alias("z"))
    worst = z.select(F.max(F.abs(normal.cdf(F.col("z")) - normal.cdf_exact(F.col("z"))))).first()[0]
    assert worst < 2e-7
    assert abs(normal.ppf(0.975) - 1.959964) < 1e-6
    with pytest.raises(ValueError):
        normal.ppf(1.0)
    with pytest.raises(Exception, match="quantile of"):
        spark.range(1).select(normal.ppf_column(F.lit(0.0))).collect()


def test_volume_overrides(spark, sf):
    s = views.player_stats(spark, sf)
    at = AsOf(2023, 3)
    who = projection.volume(s, at).orderBy("player_id").first().player_id
    assert projection.volume(s, at, overrides={who: {"targets": 9.0}}).where(F.col("player_id") == who).first().targets == 9.0
    with pytest.raises(ValueError):
        projection.volume(s, at, overrides={who: {"tackles": 1.0}})


def test_sinks(spark, tmp_path, raw):
    with pytest.raises(ValueError):
        sinks.strict_json({"a": [1.0, float("nan")]})
    assert sinks.canonical_hash({"a": 1, "b": 2}) == sinks.canonical_hash({"b": 2, "a": 1})
    m = sinks.snapshot(ingest.build_plays(raw), str(tmp_path / "snap"))
    assert m["seasons"][0]["n_rows"] == 5 and m["seasons"][0]["participation"] == 0.8
    side = sinks.export_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "csv"), "nobody")
    assert side["rows"] == 1 and "'=1+1" in spark.read.text(str(tmp_path / "csv")).collect()[1][0]


def test_cache(spark, tmp_path):
    c = tables.ParquetCache(spark, str(tmp_path))
    assert c.get("a/b:c", 1) is None
    c.put("a/b:c", spark.range(3))
    assert c.get("a/b:c", 1).count() == 3 and c.get("a/b:c", 0) is None


def test_stream_equals_batch(spark, sf):
    from tallyfield.plans.streams import st_windowed_counts
    from tallyfield.streaming.weekly import windowed_counts

    e = views.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = windowed_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("long"))
    assert sorted(batch.collect()) == sorted(st_windowed_counts(spark, sf).collect())


def test_boosted_values_see_states_and_not_plays(spark, sf):
    s = models.states(spark, sf).persist()
    one, three = attribution.fit_boosted_value(s, rounds=3, least=20), attribution.fit_boosted_value(s.union(s).union(s), rounds=3, least=60)
    assert one.stages[-1].getWeightCol() == "plays"
    p = lambda m: {(r.down, r.ydstogo, r.yardline_100): r.prediction for r in m.transform(s).select("down", "ydstogo", "yardline_100", "prediction").collect()}
    assert p(one) == pytest.approx(p(three))
    s.unpersist()


def test_drive_islands_sort_plays_once_in_tasks_of_a_size(spark, sf, monkeypatch):
    from tallyfield.plans import relational

    monkeypatch.setattr(relational, "ISLAND_ROWS", 1000)
    got = relational.p24_drive_islands(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [game_id") == 1
    n = views.read(spark, sf, "lineitem").count()
    assert f", {1 + n // 1000}), REPARTITION_BY_NUM" in plan
    assert got.agg(F.sum("n")).first()[0] == n
