"""Store, commands, state hand-over, registries, fixtures, forecasts and team effects."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import asof, evaluation, forecast, records, statespace, teams
from tallyfield.sources import store as st
from tallyfield.sources.tables import ParquetCache


@pytest.fixture
def store(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    s.init()
    return s


def test_init_twice_and_migrate(spark, store):
    assert store.init() == st.SCHEMA_VERSION and store.meta("schema_version") == "2" and store.meta("nothing") is None
    store.write("formats", spark.createDataFrame([("House", "x")], st.TABLES["formats"][0]))
    store.init()
    store.init()
    assert [tuple(r) for r in store.read("formats").collect()] == [("House", "x", None)]


def test_merge_replaces_by_key_and_old_versions_stay_readable(spark, store):
    row = lambda p, x: spark.createDataFrame([(p, 2023, 1, x)], st.TABLES["player_stats"][-1])
    store.merge("player_stats", row("a", 1.0), ["player_id", "season", "week"])
    before = store.read("player_stats")
    store.merge("player_stats", row("a", 2.0).union(row("b", 3.0)), ["player_id", "season", "week"])
    assert sorted((r.player_id, r.points) for r in store.read("player_stats").collect()) == [("a", 2.0), ("b", 3.0)]
    assert [r.points for r in before.collect()] == [1.0]
    assert store.read("player_stats", "points > 2.5").count() == 1


def test_daily_update_notes_a_season_that_fails(spark, store):
    def load(season):
        if season == 2022:
            raise OSError("no file")
        players = spark.createDataFrame([("a", "A", "QB", "t")], st.TABLES["players"][0])
        stats = spark.createDataFrame([("a", season, 1, 5.0), ("unknown", season, 1, 9.0)], st.TABLES["player_stats"][0])
        return players, stats

    got = store.daily_update(load, [2021, 2022, 2023])
    assert got == {2021: "ok", 2022: "failed: no file", 2023: "ok"}
    assert sorted((r.player_id, r.season) for r in store.read("player_stats").collect()) == [("a", 2021), ("a", 2023)]
    assert [(r.command, r.state) for r in store.read("runs").collect()] == [("daily_update", "done")]


def test_projections_that_break_a_rule_are_refused(spark, store):
    rec = lambda q90: spark.createDataFrame([("a", "QB", 2023, 1, 5, 3, 0, 0, 0.5, 0.5, 1.0, 1.0, 1.0, q90, 1)], "player_id string, position string, season int, week int, att int, comp int, tgt int, rec int, sd double, p_td double, p_active double, q10 double, q50 double, q90 double, n_same int")
    assert store.projection_run("v1", lambda: rec(2.0), records.broken) == 1
    for bad in (math.nan, math.inf, 0.5):
        with pytest.raises(ValueError):
            store.projection_run("v2", lambda: rec(bad), records.broken)
    with pytest.raises(Exception):
        store.projection_run("v1", lambda: rec(2.0), records.broken)  # a version is written once
    assert [r.state for r in store.read("runs").orderBy("started_at").collect()] == ["done", "failed", "failed", "failed", "failed"]


def test_models_are_promoted_and_rolled_back(store):
    one = store.model_rebuild("value", lambda: {"a": 1.0})
    two = store.model_rebuild("value", lambda: {"a": 2.0})
    with pytest.raises(ValueError):
        store.rollback("value")
    store.promote("value", one)
    store.promote("value", two)
    roles = lambda: {r.version: r.role for r in store.read("models").collect()}
    assert roles() == {one: "previous", two: "champion"}
    assert store.rollback("value") == one and roles() == {one: "champion", two: "previous"}
    with pytest.raises(ValueError):
        store.promote("value", one)
    with pytest.raises(ValueError):
        store.model_rebuild("value", lambda: {"a": math.nan})
    config = store.set_model_config("value", {"x": 1})
    assert store.set_model_config("value", {"x": 1}) == config not in roles() and store.read("configs").count() == 1
    with pytest.raises(ValueError, match="no candidate"):
        store.promote("value", config)


def test_a_rebuild_keeps_the_role_of_a_version_that_is_there(store):
    one = store.model_rebuild("value", lambda: {"a": 1.0})
    two = store.model_rebuild("value", lambda: {"a": 2.0})
    store.promote("value", one)
    store.promote("value", two)
    for a in (1.0, 2.0, 2.0):
        store.model_rebuild("value", lambda a=a: {"a": a})
    assert {r.version: r.role for r in store.read("models").collect()} == {one: "previous", two: "champion"}
    assert store.production("value") == two and store.production("other") is None
    with pytest.raises(ValueError, match="no candidate"):
        store.promote("value", one)  # comes back by rollback only


def test_profiles_imports_and_links(spark, store, tmp_path):
    a = store.set_scoring_profile("House", [("receptions", 1.0), ("passing_yards", 0.04)], 2.0)
    assert a == store.set_scoring_profile("Same", [("passing_yards", 0.04), ("receptions", 1.0)], 2.0)
    for weights in ([("receptions", 1.0), ("receptions", 1.0)], [("sacks", 1.0)], [("targets", math.inf)], [("targets", 0.0001)]):
        with pytest.raises(ValueError):
            store.set_scoring_profile("Bad", weights)
    (tmp_path / "o.csv").write_text("player_id,season,week,status\na,2023,1,OUT\n")
    assert store.import_overrides(f"file://{tmp_path}/o.csv") == 1
    (tmp_path / "b.csv").write_text("provider,player_id,season,week,projected\np,a,2023,1,7.5\np,b,2023,1,x\n")
    with pytest.raises(Exception):
        store.import_benchmark(f"file://{tmp_path}/b.csv")
    (tmp_path / "b.csv").write_text("provider,player_id,season,week,projected\np,a,2023,1,7.5\n")
    assert store.import_overrides(f"file://{tmp_path}/o.csv") == 0 and store.read("overrides").count() == 1  # the same file again
    assert store.import_benchmark(f"file://{tmp_path}/b.csv") == 1 and store.read("benchmarks").first().observed_at is not None
    store.append("links", spark.createDataFrame([("x", "a", 0.5, "pending", None), ("x", "b", 0.4, "pending", None)], st.TABLES["links"][0]))
    store.decide_link("x", "a", True)
    store.decide_link("x", "b", False)
    assert {r.player_id: r.state for r in store.read("links").collect()} == {"a": "approved", "b": "rejected"}
    with pytest.raises(ValueError):
        store.decide_link("x", "a", False)


def test_evaluation_run(spark, store):
    margins = spark.createDataFrame([(5, 0.5, 0.1, 0.9, True)], "n long, point double, lower double, upper double, excludes_zero boolean")
    assert store.evaluation_run(lambda: forecast.decide(margins)) == "SHIP"
    assert forecast.decide(margins.withColumn("excludes_zero", F.lit(False))).first().verdict == "FALLBACK"
    assert forecast.decide(margins.where("false")).first().verdict == "INCONCLUSIVE"


def test_state_is_saved_loaded_and_widened(spark, store):
    old = spark.createDataFrame([("a", 1.0, 0.2)], "player_id string, x0 double, x1 double")
    assert store.load_state(2023, 5, {"x2": 0.0}) is None
    store.save_state(old, 2023, 5)
    assert store.load_state(2023, 5, {"x2": 0.0}).first().asDict() == {"player_id": "a", "x0": 1.0, "x1": 0.2, "x2": 0.0}
    roster = spark.createDataFrame([("a", "QB"), ("b", "RB")], "player_id string, position string")
    got = {r.player_id: (r.x0, r.x1) for r in teams.remap_state(old, roster, {"x0": 0.0, "x1": 0.0}).collect()}
    assert got == {"a": (1.0, 0.2), "b": (0.0, 0.0)}


def test_health_registry_logger_namespace(tmp_path):
    p = str(tmp_path / "h" / "health.json")
    assert st.read_health(p) == {}
    st.write_health(p, "load", True)
    st.write_health(p, "fit", False, {"error": "x"})
    assert st.read_health(p)["load"]["ok"] and not st.read_health(p)["fit"]["ok"]
    r = forecast.promote({}, "margin", {"n": 5, "mean": 0.0, "threshold": 0.2}, "first")
    assert forecast.promote(r, "margin", {"n": 5, "mean": 0.0, "threshold": 9.0}, "second") == r
    st.save_registry(str(tmp_path / "r.json"), r)
    back = st.load_registry(str(tmp_path / "r.json"))
    assert back == r and forecast.gate_check(back, "margin", 0.3) and not forecast.gate_check(back, "margin", 0.2) and forecast.gate_check(back, "other", 1.0) is None
    log = st.get_logger("t", str(tmp_path / "t.log"))
    log = st.get_logger("t", str(tmp_path / "t.log"))
    log.warning("hello")
    assert len(log.handlers) == 2 and "hello" in (tmp_path / "t.log").read_text()
    ns = st.Namespace(str(tmp_path / "replay"), str(tmp_path / "live"))
    assert ns.path("a", "b").endswith("replay/a/b")
    with pytest.raises(ValueError):
        ns.path("..", "live")
    with pytest.raises(ValueError):
        st.Namespace(str(tmp_path / "live" / "x"), str(tmp_path / "live"))


def test_fixtures(tmp_path):
    arrays = {"f": ("f64", [1.5, -0.0, math.pi]), "i": ("i64", [1, 2**40]), "k": ("i32", [7]), "b": ("bool", [True, False]), "s": ("strings", ["a", "é"]), "r": ("ragged_f64", [[1.0], [], [2.0, 3.0]])}
    st.write_fixture(str(tmp_path), arrays)
    for name, (kind, want) in arrays.items():
        got = st.read_fixture(str(tmp_path), name)
        assert [list(x) for x in got] == want if kind.startswith("ragged") else list(got) == want
    (tmp_path / "f.bin").write_bytes(b"0" * 24)
    with pytest.raises(ValueError):
        st.read_fixture(str(tmp_path), "f")


def test_sources_by_name_are_cached(spark, tmp_path):
    calls = []

    def fetch(name, year):
        calls.append((name, year))
        if name == "rosters":
            return spark.createDataFrame([("g1", "A B", "t")], "gsis_id string, full_name string, team string")
        return spark.createDataFrame([("g", f"d{year}", 1, year, 1, "a", "b", 1, 10, 50, 4, "run", "Touchdown", 5, "p1;p2", "d1")], "game_id string, drive_id string, play_id long, season int, week int, off_team string, def_team string, down int, ydstogo int, yardline_100 int, yards int, play_type string, result string, clock int, offense_players string, defense_players string")

    cache = ParquetCache(spark, str(tmp_path))
    assert sorted(r.season for r in st.load_pbp(spark, cache, [2021, 2022], fetch).collect()) == [2021, 2022]
    assert st.load_state_plays(spark, cache, [2021, 2022], fetch).where("terminal").count() == 2
    assert st.load_rosters(spark, cache, [2021], fetch).first().player_id == "g1"
    assert calls == [("raw_pbp", 2021), ("raw_pbp", 2022), ("rosters", 2021)]
    bundle = st.load_synthetic(spark, teams=4, weeks=2, drives=2)
    assert set(bundle) == {"plays", "players", "feeder"} and bundle["feeder"].count() == bundle["players"].count()
    for f in (st.load_odds, st.load_college, st.load_vendor_pbp):
        with pytest.raises(NotImplementedError):
            f([2023])


def test_team_effects_by_hand(spark):
    plays = spark.createDataFrame([("a", "b", ["p1", "p2"], ["d1"]), ("a", "b", ["p1"], ["d2"]), ("b", "a", ["p3"], ["d3"])], "off_team string, def_team string, off_players array<string>, def_players array<string>")
    ratings = spark.createDataFrame([("p1", 1.0), ("p2", 0.5), ("d1", 0.2), ("d2", 0.4)], "player_id string, rating double")
    own = spark.createDataFrame([("off", "a", 0.1), ("def", "b", 0.3)], "side string, team string, value double")
    got = {r.team: (r.e_off, r.e_def, r.grade) for r in teams.team_effects(plays, ratings, own).collect()}
    assert got["a"] == pytest.approx((1.0 + 0.25 + 0.1, 0.0, 0.0)) and got["b"] == pytest.approx((0.0, 0.3 + 0.3, 0.6))
    rows = {(r.team, r.col): r.val for r in teams.net_market_rows(plays).collect()}
    assert rows["a", "p:p1"] == 1.0 and rows["a", "p:p2"] == 0.5 and rows["b", "p:d1"] == 0.5 and rows["a", "o:a"] == rows["b", "d:b"] == 1.0


def test_a_tough_defence_gets_the_higher_grade(spark):
    """Planted: one defence gives up less; its grade is the highest."""
    rng = np.random.default_rng(0)
    plays = [(f"t{i % 5}", f"t{(i % 5 + 1 + i // 5 % 4) % 5}", [f"p{i % 5}"], [f"d{(i % 5 + 1 + i // 5 % 4) % 5}"]) for i in range(400)]
    df = spark.createDataFrame(plays, "off_team string, def_team string, off_players array<string>, def_players array<string>")
    ratings = spark.createDataFrame([(f"d{k}", 0.5 if k == 3 else float(rng.normal(0, 0.05))) for k in range(5)], "player_id string, rating double")
    none = spark.createDataFrame([], "side string, team string, value double")
    assert teams.team_effects(df, ratings, none).orderBy(F.col("grade").desc()).first().team == "t3"


def test_windows_of_blocks(spark):
    b = spark.createDataFrame([(s, w, 1.0) for s in range(2018, 2024) for w in (1, 5)], "season int, week int, v double")
    seen = lambda *a: sorted({(r.season, r.week) for r in teams.window_blocks(b, *a).collect()})
    assert {s for s, _ in seen(2022, 1)} == {2019, 2020, 2021} and {s for s, _ in seen(2022, 4)} == {2020, 2021}
    assert (2022, 1) in seen(2022, 4, True) and (2022, 5) not in seen(2022, 4, True)
    assert teams.window_blocks(b, 2022, 4, True).first().research_only


def test_opponent_residual_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), f"c{i % 3}", int(i % 5), float(rng.normal()), float(rng.normal())) for i in range(200)] + [(900, "lone", 0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, cell string, fold int, def_sum double, dv double")
    got = {r.id: r.resid for r in teams.opponent_residual(df, "cell", "fold").collect()}
    for i, c, f, x, y in rows:
        rest = [(a, b) for _, cc, ff, a, b in rows if cc == c and ff != f]
        if not rest:
            assert got[i] == pytest.approx(y)
            continue
        a, b = np.array(rest).T
        slope = ((a - a.mean()) * (b - b.mean())).sum() / (((a - a.mean()) ** 2).sum() + 1.0)
        assert got[i] == pytest.approx(y - b.mean() - slope * (x - a.mean()))


def test_fixed_point_settles():
    ratings, credits = teams.fixed_point(lambda prior: {"q": 0.5 * prior.get("q", 0.0) + 1.0}, lambda r: 0.8 * r["q"], "q", 40)
    assert ratings["q"] == pytest.approx(1 / 0.6) and len(credits) == 40


def test_poisson_resamples(spark):
    u = spark.createDataFrame([(i, float(i % 7)) for i in range(300)], "k long, x double")
    a, b = (forecast.iid_bootstrap(df, "x", ["k"], n=400).first() for df in (u, u.repartition(7)))
    assert a == b and a.n == 300 and a.lower < a.point < a.upper
    se = np.std([i % 7 for i in range(300)]) / math.sqrt(300)
    assert (a.upper - a.lower) / 2 == pytest.approx(1.96 * se, rel=0.15)
    counts = spark.range(20000).select(forecast.poisson_count(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 12), 16, 10).cast("long")).alias("n"))
    m = counts.agg(F.avg("n"), F.variance("n")).first()
    assert m[0] == pytest.approx(1, abs=0.03) and m[1] == pytest.approx(1, abs=0.05)


def test_parity_is_bitwise_without_tolerances(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2), (2, math.nan), (3, 1.0), (4, 0.0)], "k long, x double")
    b = spark.createDataFrame([(1, 0.3), (2, math.nan), (5, 1.0), (4, -0.0)], "k long, x double")
    exact = forecast.compare(a, b, ["k"], ["x"]).first()
    assert (exact.both, exact.left_only, exact.right_only, exact.apart_x) == (3, 1, 1, 2)
    assert forecast.compare(a, b, ["k"], ["x"], absolute=1e-12).first().apart_x == 0


def test_balanced_error_by_hand(spark):
    h = spark.createDataFrame([("a", "QB", 1, 1, 10.0), ("b", "QB", 1, 1, 20.0), ("c", "QB", 1, 1, 1.0), ("d", "RB", 1, 1, 4.0), ("e", "RB", 1, 1, 8.0)], "player_id string, position string, season int, week int, points double")
    sc = {r.position: r.scale for r in forecast.position_scales(h, {"QB": 2, "RB": 2}).collect()}
    assert sc == {"QB": 5.0, "RB": 2.0}
    cells = spark.createDataFrame([("QB", 10.0, 5.0, 15.0), ("RB", 4.0, 4.0, 5.0)], "position string, forecast double, baseline double, actual double")
    r = forecast.balanced_mae(cells, forecast.position_scales(h, {"QB": 2, "RB": 2})).first()
    assert (r.engine, r.baseline) == (0.75, 1.25) and r.improvement == pytest.approx(0.4)


def test_forecasts_need_a_map(spark):
    r = spark.createDataFrame([(2023, 7, "a", "QB", 0.5), (2023, 7, "k", "K", 0.5)], "season int, week int, player_id string, position string, rating double")
    m = spark.createDataFrame([("QB", 10.0, 1.0)], "position string, slope double, intercept double")
    got = forecast.weekly_points(r, m)
    assert [(x.player_id, x.forecast) for x in got.collect()] == [("a", 6.0)]
    ros = forecast.rest_of_season_points(got.withColumnRenamed("forecast", "points_pg"), asof.AsOf(2023, 7)).first()
    assert (ros.forecast, ros.games) == (72.0, 12)


def test_pinball(spark):
    x = spark.createDataFrame([(1.0, 3.0), (5.0, 3.0)], "y double, q double")
    assert x.agg(evaluation.pinball(F.col("y"), F.col("q"), 0.9)).first()[0] == pytest.approx((0.1 * 2 + 0.9 * 2) / 2)


def test_vocabulary_is_the_contract(spark):
    t = records.component_table(spark).collect()
    assert len(records.COMPONENTS) == 18 and len(t) == len(set(t)) == 46
    assert json.dumps([c for c, _, _ in records.COMPONENTS]).count("_") > 15


def test_stream_state_outlives_batches_and_replays(spark, tmp_path):
    """Two files in two batches, the second holding rows of the first again."""
    from tallyfield.streaming.stateful import NOISE, talent_updates

    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = [(f"u{i % 3}", i, float(i % 17)) for i in range(60)]
    schema = "player_id string, event_id long, value double"
    for part in (rows[:30], rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        s = talent_updates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
        out: dict = {}
        s.writeStream.outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).foreachBatch(lambda df, _: out.update({r.player_id: r for r in df.collect()})).start().awaitTermination()
    for u in ("u0", "u1", "u2"):
        mine = [x for p, _, x in rows if p == u]
        assert (out[u].n, out[u].total) == (20, int(sum(mine)))
        assert out[u].talent == pytest.approx(sum(mine) / 20 / (20 + NOISE)) and out[u].var == pytest.approx(1 / (1 + 20 / NOISE))


def test_read_models_by_hand(spark):
    from tallyfield.operators import status

    runs = spark.sql("""select * from values (1, 'a', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:01:00', 'done'), (2, 'a', timestamp_ntz'2024-01-01 01:00:00', timestamp_ntz'2024-01-01 01:01:00', 'failed'),
        (3, 'b', timestamp_ntz'2024-01-01 00:00:00', null, 'running') t(run_id, source, started_at, finished_at, state)""")
    t = spark.createDataFrame([("a", 60), ("b", 60), ("c", 60)], "source string, minutes int")
    at = lambda now: {r.source: (r.age_seconds, r.state) for r in status.freshness(runs, t, now).collect()}
    assert at("2024-01-01 00:31:00") == {"a": (1800, "Fresh"), "b": (-1, "Missing"), "c": (-1, "Missing")}
    assert at("2024-01-01 02:31:00")["a"] == (9000, "Stale")
    assert [(r.source, r.run_id, r.state, r.failed) for r in status.last_runs(runs).collect()] == [("a", 2, "failed", 1)]
    assert [(r.source, r.n, r.first_run) for r in status.running(runs).collect()] == [("b", 1, 3)]
