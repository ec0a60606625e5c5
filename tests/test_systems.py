"""Solvers without dense matrices, interactions and boosted residuals against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield import views
from tallyfield.operators import attribution, boosting, solver, teams
from tallyfield.plans import models, systems


def sums_of(gram):
    return {(r.i, r.j): r.v for r in gram.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def test_cg_equals_the_dense_solve(spark, sf):
    g = systems.system(spark, sf).persist()
    scale = systems.position_scale(views.players(spark, sf))
    prior = spark.createDataFrame([("p:p1", 0.5), ("o:3", -0.2)], "col string, mean double")
    got = solver.conjugate_gradient(g, prior=prior, scale=scale, tol=1e-13)
    want = attribution.solve_system(sums_of(g), prior={"p:p1": 0.5, "o:3": -0.2}, scale={r.col: r.factor for r in scale.collect()})
    have = {r.col: r.rating for r in got.ratings.collect()}
    assert have.keys() == want.keys() and got.columns == len(want) > 150
    assert max(abs(have[k] - want[k]) for k in want) < 1e-9
    assert got.converged and got.residual < 1e-11 and got.steps == len(got.history) - 1 and got.history[-1] < 1e-13 < got.history[-2]
    short = solver.conjugate_gradient(g, scale=scale, steps=3)
    assert not short.converged and short.steps == 3 and 1e-10 < short.residual < 1
    g.unpersist()


def test_cg_of_many_columns_and_of_none(spark):
    n = 50_000
    k = spark.range(n)
    name = lambda c: F.format_string("p:%05d", c)
    near = [k.select(name(F.col("id")).alias("i"), name(F.col("id") + s).alias("j"), F.lit(w).alias("v")).where(F.col("id") + s < n) for s, w in ((0, 9.0), (1, -2.0), (7, 1.5), (300, -0.5))]
    right = k.select(name(F.col("id")).alias("i"), F.lit(None).cast("string").alias("j"), F.sin(F.col("id").cast("double")).alias("v"))
    gram = near[0].unionByName(near[1]).unionByName(near[2]).unionByName(near[3]).unionByName(right)
    got = solver.conjugate_gradient(gram, lam=1.0, tol=1e-9)
    assert got.converged and got.columns == n and got.residual < 1e-8 and got.steps < 40
    x = np.array([r.rating for r in got.ratings.orderBy("col").collect()])
    y = 10 * x
    for s, w in ((1, -2.0), (7, 1.5), (300, -0.5)):
        y[s:] += w * x[:-s]
        y[:-s] += w * x[s:]
    assert np.abs(y - np.sin(np.arange(n))).max() < 1e-6
    none = solver.conjugate_gradient(gram.limit(0))
    assert none.columns == 0 and none.converged and none.ratings.count() == 0
    still = solver.conjugate_gradient(spark.createDataFrame([("p:a", "p:a", 3.0), ("p:a", None, 0.0)], "i string, j string, v double"))
    assert [tuple(r) for r in still.ratings.collect()] == [("p:a", 0.0)]


def test_stretches_give_the_same_as_one_solve_an_origin(spark):
    rng = np.random.default_rng(2)
    slots = [(2000 + k // 3, k % 3 + 1) for k in range(11)]
    cols = ["d:a", "o:a", "p:1", "p:2", "p:3", "x:1|2"]
    rows = []
    for k, (season, week) in enumerate(slots):
        use = cols[: 3 + k // 2] if k < 6 else cols
        x = rng.normal(size=(6, len(use)))
        y = rng.normal(size=6)
        for a, i in enumerate(use):
            rows.append((season, week, i, None, float(x[:, a] @ y)))
            rows += [(season, week, i, use[b], float(x[:, a] @ x[:, b])) for b in range(a, len(use)) if (a + b + k) % 4]
    blocks = spark.createDataFrame(rows, "season int, week int, i string, j string, v double")
    for origins, size in ((slots[2:], 3), (slots[1::2], 2), (slots[3:4], 8)):
        dealt = solver.stretches(blocks, slots, origins, size)
        got = {}
        for r in solver.solve_stretches(dealt, slots, origins, size, 40.0).collect():
            got.setdefault((r.season, r.week), {})[r.col] = r.rating
        assert sorted(got) == origins
        for o in origins:
            sums = {}
            for season, week, i, j, v in rows:
                if (season, week) < o:
                    sums[i, j] = sums.get((i, j), 0.0) + v
            want = attribution.solve_system(sums, 40.0, scale={"x:1|2": 10.0})
            assert got[o] == pytest.approx(want, abs=1e-10)


def test_origin_system_is_what_the_ratings_are_solved_from(spark, sf):
    g = systems.e13_origin_system(spark, sf)
    sums = {(r.i, r.j): r.v for r in g.collect()}
    assert {k[0] for k, _ in sums} == {"p", "o", "d"} and len(sums) > 5000
    one = models.valued(spark, sf).where("season < 1997 or (season = 1997 and week < 6)")
    direct = sums_of(attribution.gram_blocks(attribution.design(one, views.players(spark, sf)), one, []))
    assert sums.keys() >= {k for k, x in direct.items() if x} and max(abs(sums[k] - direct[k]) for k in direct) < 1e-6


def brute_tree(bins, n, s, least):
    """Best single split over all features and cuts, by trying each."""
    best = (0.0, None, None)
    for f in range(bins.shape[1]):
        for cut in range(int(bins[:, f].max())):
            low = bins[:, f] <= cut
            if n[low].sum() >= least and n[~low].sum() >= least:
                gain = s[low].sum() ** 2 / n[low].sum() + s[~low].sum() ** 2 / n[~low].sum() - s.sum() ** 2 / n.sum()
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    return best


def test_a_tree_is_the_best_split():
    rng = np.random.default_rng(1)
    for _ in range(20):
        bins = rng.integers(0, 6, (60, 3))
        n, y = rng.integers(1, 9, 60), rng.normal(size=60) + (bins[:, 1] > 2)
        s = n * y
        got = boosting.grow(bins, n, s, 1, 1, 1.0, 20, np.ones(60, bool))
        mean = s.sum() / n.sum()
        _, f, cut = brute_tree(bins, n, s - n * mean, 20)
        low = bins[:, f] <= cut
        want = np.where(low, s[low].sum() / n[low].sum(), s[~low].sum() / n[~low].sum())
        assert got == pytest.approx(want)
    # the depth is used, and cells outside the training ones are predicted and not learnt
    bins = np.stack(np.meshgrid(np.arange(4), np.arange(4)), -1).reshape(-1, 2)
    y = ((bins[:, 0] > 1) ^ (bins[:, 1] > 1)).astype(float)
    y[0] = 100.0
    got = boosting.grow(bins, np.full(16, 10), 10 * y, 60, 2, 0.5, 1, np.arange(16) > 0)
    assert got[0] == pytest.approx(0.0, abs=0.1) and got[1:] == pytest.approx(y[1:], abs=0.1)


def test_bins_keep_order_and_bound_their_number(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.exp(F.col("id") / 1000).alias("b"), F.when(F.col("id") > 10, F.col("id") / 3).alias("c"), F.lit(2.0).alias("d"))
    rows = boosting.with_bins(df, ["a", "b", "c", "d"], bins=40).collect()
    for x, k, most in (("a", "_b0", 7), ("b", "_b1", 40), ("c", "_b2", 40), ("d", "_b3", 1)):
        pairs = sorted((r[x], r[k]) for r in rows if r[x] is not None)
        assert all(p[1] <= q[1] for p, q in zip(pairs, pairs[1:])) and 0.9 * most <= len({p[1] for p in pairs}) <= most
    assert all(r["_b2"] == 0 for r in rows if r.c is None)


@pytest.fixture(scope="module")
def planted(spark):
    """Plays whose value steps with the defenders' sum, in a way that turns with the field."""
    rng = np.random.default_rng(6)
    rows = []
    rating = {f"d{k}": float(rng.normal()) for k in range(30)}
    for k in range(12_000):
        on = [f"d{x}" for x in rng.choice(30, 3, replace=False)]
        strength = sum(rating[x] for x in on)
        down, togo, line = int(rng.integers(1, 5)), int(rng.integers(1, 20)), int(rng.integers(1, 100))
        context = 0.3 * down - 0.02 * togo + (1.5 if strength > 1 else -0.5) * (1 if line > 50 else 0.2)
        who = f"p{rng.integers(0, 20)}"
        credit = 0.4 if who == "p0" else 0.0
        rows.append((f"d{k // 8}", k, 2020, k * 17 // 12_000 + 1, down, togo, line, [who], on, context, context + credit + float(rng.normal()) * 0.3))
    cols = "drive_id string, play_id long, season int, week int, down int, ydstogo int, yardline_100 int, off_players array<string>, def_players array<string>, context double, dv double"
    return spark.createDataFrame(rows, cols).persist(), spark.createDataFrame(list(rating.items()), "player_id string, rating double")


def test_a_boosted_surface_takes_out_what_a_line_leaves(planted):
    plays, rating = planted
    r = attribution.boosted_residual(plays, rating)
    assert r.count() == 12_000
    left = lambda df: df.where("off_players[0] <> 'p0'").groupBy((F.col("def_sum") > 1).alias("_s"), (F.col("yardline_100") > 50).alias("_l")).agg(F.avg("resid").alias("m")).agg(F.max(F.abs("m"))).first()[0]
    line = teams.opponent_residual(r.drop("resid", "g").withColumn("_cell", F.col("down")), "_cell", "fold")
    assert left(line) > 0.2 and left(r) < 0.06
    mine = {x.player_id: x.credit for x in attribution.weekly_credit(r).groupBy("player_id").agg(F.avg("credit").alias("credit")).collect()}
    assert 0.33 < mine["p0"] < 0.45 and all(abs(c) < 0.08 for k, c in mine.items() if k != "p0")


def test_no_row_is_predicted_by_its_own_fold(planted):
    plays, rating = planted
    weeks = [r.week for r in plays.select("week").distinct().collect()]
    fold = {w: plays.where(F.col("week") == w).select(attribution.fold_of(F.col("season"), F.col("week"))).first()[0] for w in weeks}
    chosen = fold[weeks[0]]
    same = [w for w in weeks if fold[w] == chosen]
    moved = plays.withColumn("dv", F.when(F.col("week").isin(same), F.col("dv") + 1000).otherwise(F.col("dv")))
    a = {r.play_id: r.g for r in attribution.boosted_residual(plays, rating, rounds=10).where(F.col("week").isin(same)).collect()}
    b = {r.play_id: r.g for r in attribution.boosted_residual(moved, rating, rounds=10).where(F.col("week").isin(same)).collect()}
    assert a == b and len(a) > 500


def test_fixed_point_with_a_boosted_surface(spark, planted):
    """The planted quarterback's credit comes out, becomes the prior mean, and moves the rating."""
    plays, _ = planted
    plays = plays.withColumns({"off_team": F.lit("a"), "def_team": F.lit("b")})
    players = plays.select(F.explode(F.concat("off_players", "def_players")).alias("player_id")).distinct().persist()
    gram = attribution.play_gram(plays, players, [])
    ratings, credits = systems.boosted_fixed_point(plays, gram, None, "p0", rounds=2, boosts=60)
    assert len(credits) == 2 and all(0.3 < c < 0.5 for c in credits)
    x = {r.col: r.rating for r in ratings.collect()}
    want = attribution.solve_system(sums_of(gram), prior={"p:p0": credits[0]})
    assert x == pytest.approx(want, abs=1e-9)
    assert x["p:p0"] == max(v for k, v in x.items() if k.startswith("p:p"))


def test_large_systems_take_the_iterative_way(spark, sf):
    g = systems.system(spark, sf).persist()
    a = {r.col: r.rating for r in solver.ridge_ratings(g).collect()}
    b = {r.col: r.rating for r in solver.ridge_ratings(g, dense=10).collect()}
    assert a == pytest.approx(b, abs=1e-7)
    g.unpersist()


def test_interactions_equal_a_dense_design(spark):
    rng = np.random.default_rng(12)
    position = {**{f"w{k}": "WR" for k in range(4)}, **{f"q{k}": "QB" for k in range(2)}, **{f"d{k}": "DEF" for k in range(4)}}
    for cb in (False, True):
        if cb:
            position |= {"d0": "CB", "d1": "CB"}
        rows = []
        for k in range(300):
            off = [f"w{x}" for x in rng.integers(0, 4, 2)] + [f"q{rng.integers(0, 2)}"] + (["nobody"] if k % 9 == 0 else [])
            rows.append((f"d{k // 6}", k, 2020 + k % 2, 1, "a", "b", off, [f"d{int(x)}" for x in rng.choice(4, 2, p=[0.55, 0.3, 0.1, 0.05])], float(rng.normal())))
        plays = spark.createDataFrame(rows, "drive_id string, play_id long, season int, week int, off_team string, def_team string, off_players array<string>, def_players array<string>, dv double")
        players = spark.createDataFrame(list(position.items()), "player_id string, position string")
        proxy = "CB" if cb else "DEF"
        met = {}
        for r in rows:
            for a in r[6]:
                for b in r[7]:
                    if position.get(a) == "WR" and position[b] == proxy:
                        met[a, b] = met.get((a, b), 0) + 1
        kept = {p for p, n in met.items() if n >= 30}
        assert kept and (cb or len(kept) < len(met))
        cols = ["o:a", "d:b", *(f"p:{p}" for p in position), *(f"x:{a}|{b}" for a, b in kept)]
        for by in ([], ["season"]):
            want = {}
            for r in rows:
                x = dict.fromkeys(cols, 0.0)
                x["o:a"], x["d:b"] = 1.0, -1.0
                for a in r[6]:
                    if a in position:
                        x[f"p:{a}"] += 1
                    for b in r[7]:
                        if (a, b) in kept:
                            x[f"x:{a}|{b}"] += 1
                for b in r[7]:
                    x[f"p:{b}"] -= 1
                key = (r[2],) if by else ()
                full = {i: a for i, a in x.items() if a}
                for i, a in full.items():
                    for j, b in [*((j, b) for j, b in full.items() if i <= j), (None, r[8])]:
                        want[(*key, i, j)] = want.get((*key, i, j), 0.0) + a * b
            got = {tuple(r[c] for c in [*by, "i", "j"]): r.v for r in attribution.play_gram(plays, players, by, interactions=30).collect()}
            assert {k for k, x in got.items() if x} <= want.keys() <= got.keys()
            assert all(got[k] == pytest.approx(want.get(k, 0.0), abs=1e-9) for k in got)
        support = {(r.a, r.b): r.n for r in attribution.pair_support(plays, players).collect()}
        assert support == {p: met[p] for p in kept}


def test_volume_pools_by_hand(spark):
    from tallyfield.operators import projection

    rng = np.random.default_rng(5)
    rows, want = [], {}
    for pos, rate in (("QB", (20.0, 6.0)), ("WR", (4.0, 2.0))):
        y, g = [], []
        for i in range(40):
            games = int(rng.integers(0, 17))
            total = int(rng.poisson(max(rng.normal(*rate), 0.1) * games)) if games else 0
            rows.append((f"{pos}{i}", pos, games, total, 3 * games, None))
            if games:
                y.append(total), g.append(games)
        y, g = np.array(y, float), np.array(g, float)
        mean = y.sum() / g.sum()
        s2 = (g * (y / g - mean) ** 2).sum() / g.sum()
        tau = s2 - mean * len(g) / g.sum()
        want[pos] = (mean, tau, mean / tau)
    usage = spark.createDataFrame(rows, "player_id string, position string, games int, pass_attempts int, rush_attempts int, targets int")
    pools = projection.volume_pools(usage)
    got = {(r.position, r.driver): r for r in pools.collect()}
    for pos, (mean, tau, k) in want.items():
        r = got[pos, "pass_attempts"]
        assert (r["mean"], r.between, r.k) == pytest.approx((mean, tau, k))
        assert got[pos, "rush_attempts"].k is None and got[pos, "targets"].k is None  # all alike
    with pytest.raises(projection.DegeneratePool):
        projection.expected_volume(usage, pools)
    e = {r.player_id: r for r in projection.expected_volume(usage, pools, degenerate="mean").collect()}
    assert e.keys() == {r[0] for r in rows if r[2]}
    for who, pos, games, total, *_ in rows:
        if games:
            mean, _, k = want[pos]
            assert e[who].pass_attempts == pytest.approx((total + k * mean) / (games + k)) and e[who].rush_attempts == pytest.approx(3.0) and e[who].targets == 0
    one = projection.volume_pools(usage.where("position = 'QB'"), ["pass_attempts"])
    assert projection.expected_volume(usage.where("position = 'QB'"), one, ["pass_attempts"]).count() > 30


def test_growing_holds_few_bytes_a_cell():
    import tracemalloc

    rng = np.random.default_rng(3)
    bins = rng.integers(0, 200, (300_000, 4)).astype(np.uint8)
    n, s = rng.integers(1, 5, len(bins)).astype(float), rng.normal(size=len(bins))
    tracemalloc.start()
    boosting.grow(bins, n, s, 2, 3, 0.1, 100, n > 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(bins)


def test_models_do_not_meet_in_a_task(spark, planted):
    plays, rating = planted
    r = attribution.boosted_residual(plays, rating, rounds=1)
    assert "REPARTITION_BY_NUM" in r._jdf.queryExecution().executedPlan().toString()  # not put together by size
    at = spark.range(5).select(F.col("id").cast("int").alias("m")).repartition(80, "m").select(F.spark_partition_id().alias("p"))
    assert len({x.p for x in at.collect()}) == 5


def _scans(df, name):
    plan = df._jdf.queryExecution().optimizedPlan()
    return sum(name in str(plan.collectLeaves().apply(k).relation().location().rootPaths()) for k in range(plan.collectLeaves().size()) if plan.collectLeaves().apply(k).nodeName().startswith("LogicalRelation"))


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count(" Exchange ")


def test_cells_and_teams_come_from_one_pass(spark, sf):
    """Means are those of two passes, and the system's plan reads the line items once."""
    s = models.states(spark, sf)
    values, strength = attribution.cell_and_team_values(s)
    assert sorted(map(tuple, values.collect())) == sorted(map(tuple, attribution.cell_values(s).collect()))
    want = s.groupBy("off_team").agg(F.avg("drive_points")).collect()
    assert {r.team: r.strength for r in strength.collect()} == {r[0]: r[1] for r in want} and len(want) == 25
    assert _scans(systems.system(spark, sf), "lineitem.parquet") == 1


def test_lists_of_ids_leave_blanks_out(spark):
    from tallyfield.operators import ingest

    given = ["a;b", "", " ", ";", "a;;b", ";a", "a;", "a; ;b", " a;b ", None, "a", "a;\t;b", "a;\n", "\n", "  ;b", "a;  "]
    got = spark.createDataFrame(list(enumerate(given)), "k int, ids string").orderBy("k").select(ingest.split_ids(F.col("ids")).alias("x")).collect()
    assert [r.x for r in got] == [[x for x in (ids or "").split(";") if x.strip(" ")] for ids in given]


def test_interactions_meet_where_the_plays_are(spark, sf, monkeypatch):
    """A column for pairs asks for no shuffle of plays; many pairs are joined and give the same."""
    valued, who = models.valued(spark, sf).persist(), views.players(spark, sf)
    few = attribution.play_gram(valued, who, [], interactions=3)
    assert _exchanges(few) == _exchanges(attribution.play_gram(valued, who, []))
    got = sums_of(few)
    assert any(i.startswith("x:") for i, _ in got)
    monkeypatch.setattr(attribution, "PAIRS", 3)
    many = sums_of(attribution.play_gram(valued, who, [], interactions=3))
    assert many.keys() == got.keys() and many == pytest.approx(got, abs=1e-7)
    assert sums_of(attribution.play_gram(valued, who, [], interactions=10**9)) == pytest.approx(sums_of(attribution.play_gram(valued, who, [])), abs=1e-7)
    valued.unpersist()


def test_gram_shuffles_sums_and_no_products(spark, sf, monkeypatch):
    from tallyfield.operators import gram

    valued = models.valued(spark, sf).persist()
    g = attribution.play_gram(valued, views.players(spark, sf), [])
    assert "Generate" not in g._jdf.queryExecution().executedPlan().toString()
    want = sums_of(attribution.gram_blocks(attribution.design(valued, views.players(spark, sf)), valued, []))
    got = sums_of(g)
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-7)
    valued.unpersist()
    # a task that may hold only few sums tells them in parts; ids that stand twice, null ids and targets
    import pyarrow as pa

    rows = [{"week": k % 3, "dv": None if k % 5 == 0 else float(k), "off_players": ["a", "a", None], "def_players": [f"b{k % 7}", "a"], "off_team": "x", "def_team": None, "pairs": [{"col": "x:a|b", "val": 2.0}]} for k in range(90)]
    kinds = pa.schema([("week", pa.int32()), ("dv", pa.float64()), ("off_players", pa.list_(pa.string())), ("def_players", pa.list_(pa.string())), ("off_team", pa.string()), ("def_team", pa.string()), ("pairs", pa.list_(pa.struct([("col", pa.string()), ("val", pa.float64())])))])
    want = {}
    for r in rows:
        e = [("p:a", 2.0 - 1.0), ("p:" + r["def_players"][0], -1.0), ("o:x", 1.0), ("x:a|b", 2.0)]
        for i, x in e:
            for j, y in e:
                if i <= j:
                    want[r["week"], i, j] = want.get((r["week"], i, j), 0.0) + x * y
            want[r["week"], i, None] = want.get((r["week"], i, None), 0.0) + x * (r["dv"] or 0.0)
    for held in (gram.HELD, 5):
        monkeypatch.setattr(gram, "HELD", held)
        monkeypatch.setattr(gram, "ROWS", 7)
        got = {}
        for t in gram.added_up(pa.Table.from_pylist(rows, kinds).to_batches(20), ["week"]):
            for r in t.to_pylist():
                got[r["week"], r["i"], r["j"]] = got.get((r["week"], r["i"], r["j"]), 0.0) + (r["v"] or 0.0)
        assert got == pytest.approx(want)


def test_plays_are_dealt_once(spark, sf):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(models.states(spark, sf)) <= 4  # customers, orders by customer and by drive, line items by drive
        # values of states go to the plays (the buckets' own pass and sums are the rest)
        assert "SortMergeJoin [b0" not in models.valued(spark, sf)._jdf.queryExecution().executedPlan().toString()
        rating = views.players(spark, sf).select("player_id", F.lit(1.0).alias("rating"))
        p = views.plays(spark, sf)
        assert _exchanges(attribution.with_def_sum(p, rating)) == _exchanges(p)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_def_sum_in_place_is_that_of_the_joins(spark, planted, monkeypatch):
    plays, rating = planted
    few = {r.play_id: r.def_sum for r in attribution.with_def_sum(plays, rating.where("player_id <> 'd3'")).collect()}
    monkeypatch.setattr(attribution, "IN_PLACE", 3)
    many = {r.play_id: r.def_sum for r in attribution.with_def_sum(plays, rating.where("player_id <> 'd3'")).collect()}
    assert len(few) == 12_000 and few == pytest.approx(many)
