"""Each guard passes what is right and catches its canary."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfield import views
from tallyfield.operators import asof, attribution, evaluation, guards, statespace, weekly
from tallyfield.operators.asof import AsOf, LeakageError
from tallyfield.plans import models
from tallyfield.sources import store as st

LOCK = dt.datetime(2023, 10, 1)
AT = AsOf(1998, 6)


@pytest.fixture(scope="module")
def states(spark, sf):
    return models.states(spark, sf).persist()


@pytest.fixture(scope="module")
def history(spark, sf):
    return views.history(spark, sf).persist()


def test_g1_the_future_moves_no_forecast(history):
    at = AsOf(2023, 5)
    for f in (asof.persistence, asof.season_to_date, asof.last_season, asof.recency_mean):
        guards.future_poisoning(lambda s, a, f=f: f(s["history"], a), {"history": history}, at, {"history": ["points"]})
    everything = lambda s, a: s["history"].groupBy("player_id").agg(F.avg("points").alias("forecast"))
    with pytest.raises(LeakageError, match="future of history"):
        guards.future_poisoning(everything, {"history": history}, at, {"history": ["points"]})


def test_g1_and_g10_ratings_and_frozen_values(spark, sf, states):
    players = views.players(spark, sf)
    slots = sorted((r.season, r.week) for r in states.select("season", "week").distinct().collect())
    first = AsOf(*slots[6])
    near = states.where(F.col("season") * 100 + F.col("week") <= slots[8][0] * 100 + slots[8][1]).persist()

    def frozen(s, at):
        return evaluation.walk_forward_ratings(s["plays"], players, warmup_weeks=6).where((F.col("season") == at.season) & (F.col("week") == at.week))

    def refitted(s, at):  # values from the whole log
        v = attribution.play_values(s["plays"], attribution.cell_values(s["plays"]))
        g = attribution.play_gram(v.where(at.outcome), players, [])
        return g.groupBy("i", "j").agg(F.round(F.sum("v"), 6).alias("v"))

    columns = {"plays": ["drive_points", "terminal_value"]}
    guards.future_poisoning(frozen, {"plays": near}, first, columns)
    with pytest.raises(LeakageError):
        guards.future_poisoning(refitted, {"plays": near}, first, columns)


def test_g2_and_g3_watermark_and_tripwire(spark, history):
    at = AsOf(2023, 1)
    slots = lambda *x: spark.createDataFrame(list(x), "season int, week int")
    guards.absorbed(slots((2022, 18)), at)
    guards.absorbed(slots().limit(0), at)
    for late in ((2023, 1), (2023, 2), (2024, 1)):
        with pytest.raises(LeakageError, match="absorbed"):
            guards.absorbed(slots((2022, 18), late), at)
    t = guards.Tripwire(history.where(at.outcome), at)
    n = len(t)
    t.add(history.where("season = 2022").limit(1))
    assert len(t) == n + 1
    t.add(history.where("season = 2023").limit(1))
    for read in (t.read, t.__len__):
        with pytest.raises(LeakageError):
            read()
    with pytest.raises(LeakageError, match="undated"):
        guards.Tripwire(history.drop("season"), at)


def test_g4_walk_forward_is_the_weekly_path(spark, sf, states, tmp_path):
    players = views.players(spark, sf)
    slots = sorted((r.season, r.week) for r in states.select("season", "week").distinct().collect())[:7]
    few = states.where(F.struct("season", "week") <= F.struct(F.lit(slots[-1][0]), F.lit(slots[-1][1]))).persist()
    offline = evaluation.walk_forward_ratings(few, players, warmup_weeks=4).where((F.col("season") == slots[6][0]) & (F.col("week") == slots[6][1]))
    s = st.Store(spark, str(tmp_path / "s"))
    s.init()
    warm = few.where(F.struct("season", "week") < F.struct(F.lit(slots[4][0]), F.lit(slots[4][1])))
    mean = warm.agg(F.avg("drive_points")).first()[0]
    buckets = [few.select(attribution.state_bucket(*(F.col(n + c) for c in attribution.STATE)).alias("bucket")) for n in ("", "n_")]
    values = buckets[0].union(buckets[1]).where("bucket is not null").distinct().join(attribution.cell_values(warm), "bucket", "left").withColumn("value", F.coalesce("value", F.lit(mean)))
    valued = attribution.play_values(few, values).persist()
    for season, week in slots[:6]:
        weekly.weekly_update(s, season, week, valued, players)
    last = s.read("ratings", f"season = {slots[5][0]} and week = {slots[5][1]} and situation = 'overall'")
    guards.two_paths(offline, last, ["col"], "rating")
    with pytest.raises(LeakageError, match="differ"):
        guards.two_paths(offline, last.withColumn("rating", F.col("rating") + F.when(F.col("col") == "o:1", 1e-6).otherwise(0)), ["col"], "rating")


def test_g5_to_g7_what_was_published_before_the_lock(spark):
    rows = spark.createDataFrame([(2023, 3, 1.0, dt.datetime(2023, 9, 20)), (2023, 3, 9.0, dt.datetime(2023, 10, 2)), (2023, 3, 8.0, None)], "season int, week int, x double, published_at timestamp")
    at = AsOf(2023, 5)
    assert [r.x for r in guards.locked(rows, at, LOCK).collect()] == [1.0]
    research = guards.locked(rows, at, LOCK, research=True).collect()
    assert len(research) == 3 and all(r.research_only for r in research)
    told = "player_id string, season int, week int, announced_at timestamp"
    ok = [("a", 2023, 5, dt.datetime(2023, 9, 1)), ("b", 2023, 5, dt.datetime(2023, 10, 3)), ("c", 2023, 6, dt.datetime(2023, 9, 1))]
    assert [r.player_id for r in guards.announced(spark.createDataFrame(ok, told), at, LOCK).collect()] == ["a"]
    for bad in (("d", 2024, 1, dt.datetime(2023, 9, 1)), ("e", 2023, 1, None)):
        with pytest.raises(LeakageError):
            guards.announced(spark.createDataFrame([*ok, bad], told), at, LOCK)
    lines = [("a", 0.1, dt.datetime(2023, 9, 1)), ("a", 0.3, dt.datetime(2023, 9, 30)), ("b", -0.2, dt.datetime(2023, 9, 2))]
    kind = "team string, strength double, quoted_at timestamp"
    assert {r.team: r.strength for r in guards.market_at(spark.createDataFrame(lines, kind), LOCK).collect()} == {"a": 0.3, "b": -0.2}
    with pytest.raises(LeakageError, match="after the lock"):
        guards.market_at(spark.createDataFrame([*lines, ("b", 0.5, LOCK)], kind), LOCK)


def test_g8_and_g9_universe_and_namespace(spark, states, tmp_path):
    pool = AT.slice_pool(states)
    guards.universe(pool, states, AT)
    late = states.where(~AT.outcome).limit(1).withColumns({"off_players": F.array(F.lit("rookie"))}).select(*states.columns)
    with pytest.raises(LeakageError, match="rookie"):
        guards.universe(pool.union(spark.createDataFrame([("rookie",)], "player_id string")), states.unionByName(late), AT)
    st.Namespace(str(tmp_path / "replay"), str(tmp_path / "live"))
    with pytest.raises(ValueError):
        st.Namespace(str(tmp_path / "live"), str(tmp_path / "live"))


def test_g11_and_g12_versions_labels_folds(spark, history, states):
    v = guards.data_version(history)
    assert guards.data_version(history.repartition(7).orderBy("points")) == v
    guards.replayed(history, v)
    fixed = history.withColumn("points", F.when((F.col("player_id") == "u3") & (F.col("week") == 2), F.col("points") + 0.1).otherwise(F.col("points")))
    with pytest.raises(LeakageError, match="recorded"):
        guards.replayed(fixed, v)
    assert guards.data_version(history.union(history.limit(1))) != v
    labels = spark.createDataFrame([("a", "REG"), ("b", "REG")], "player_id string, season_type string")
    guards.regular_only(labels)
    with pytest.raises(LeakageError):
        guards.regular_only(labels.union(spark.createDataFrame([("c", "POST")], labels.schema)))
    folds = states.withColumn("fold", attribution.fold_of(F.col("season"), F.col("week")))
    guards.whole_weeks(folds)
    with pytest.raises(LeakageError, match="split"):
        guards.whole_weeks(states.withColumn("fold", F.col("play_id") % 5))


def test_g13_the_first_state_is_blind(spark, sf):
    s = models.series(spark, sf).persist()
    guards.blind_start(lambda x: statespace.filtered(x, semantics="corrected"), s)
    with pytest.raises(LeakageError, match="first filtered"):
        guards.blind_start(lambda x: statespace.filtered(x, semantics="oracle"), s)


def test_the_bound_reaches_every_scan_of_an_outcome(spark, history, tmp_path):
    at = AsOf(2023, 5)
    flat, parts = f"file://{tmp_path}/flat", f"file://{tmp_path}/parts"
    history.write.parquet(flat)
    history.write.partitionBy("season").parquet(parts)
    a, b = spark.read.parquet(flat), spark.read.parquet(parts)
    mean = lambda df: df.groupBy("player_id").agg(F.avg("points"))
    assert guards.unguarded_scans(mean(a.where(at.outcome)), [flat[7:]]) == []
    assert guards.unguarded_scans(mean(b.where(at.outcome)), [parts[7:]]) == []
    assert guards.unguarded_scans(mean(a), [flat[7:]]) == [flat[7:]]
    assert guards.unguarded_scans(mean(b.where("season <= 2023")), [parts[7:]]) == [parts[7:]]  # no week
    both = mean(a.where(at.outcome)).join(b, "player_id")
    assert guards.unguarded_scans(both, [flat[7:], parts[7:]]) == [parts[7:]]


def test_the_order_of_a_sum_is_no_leak(spark):
    a = spark.createDataFrame([("x", 0.1 + 0.2, 1), ("x", 5.0, 1), ("y", None, 2), (None, float("nan"), 3)], "player_id string, forecast double, n int")
    b = spark.createDataFrame([("y", None, 2), ("x", 5.0, 1), ("x", 0.3, 1), (None, float("nan"), 3)], "player_id string, forecast double, n int")
    assert guards.same_rows(a, b)
    assert not guards.same_rows(a, b.withColumn("forecast", F.col("forecast") + 1e-6))
    assert not guards.same_rows(a, b.where("n < 3")) and not guards.same_rows(a, a.unionByName(b.limit(1)))
    assert not guards.same_rows(a, b.withColumn("n", F.col("n") + 1))


def test_a_long_path_hides_no_scan(spark, history, tmp_path):
    at = f"{tmp_path}/{'long' * 40}/flat"
    history.write.parquet(f"file://{at}")
    mean = spark.read.parquet(f"file://{at}").groupBy("player_id").agg(F.avg("points"))
    assert guards.unguarded_scans(mean, [at]) == [at]
