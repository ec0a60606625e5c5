"""The commit log: partitions, races, crashes; models that come back as they were."""

import json

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import attribution
from tallyfield.plans import models
from tallyfield.sources import store as st
from tallyfield.sources.commits import CommitLog, Conflict


@pytest.fixture
def store(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    s.init()
    return s


def stats(spark, rows):
    return spark.createDataFrame(rows, st.TABLES["player_stats"][0])


KEYS = ["player_id", "season", "week"]


def test_a_merge_rewrites_the_partitions_of_its_keys_only(spark, store):
    store.merge("player_stats", stats(spark, [(f"p{k}", 1990 + s, 1, float(s)) for s in range(30) for k in range(3)]), KEYS)
    before = store.log.last()[1]["tables"]["player_stats"]["parts"]
    store.merge("player_stats", stats(spark, [("p1", 2003, 1, 99.0), ("new", 2003, 2, 1.0)]), KEYS)
    after = store.log.last()[1]["tables"]["player_stats"]["parts"]
    assert len(before) == 30 and {k for k in after if after[k] != before[k]} == {"2003"}
    assert store.read("player_stats", parts=[(2003,)]).count() == 4 and store.read("player_stats").count() == 91
    assert store.read("player_stats", "points = 99").first().player_id == "p1"
    assert "season=" not in str(store.read("player_stats").inputFiles()) and len(store.read("player_stats", parts=[(2003,)]).inputFiles()) <= 4


def test_two_rows_of_one_key_are_refused_or_ordered(spark, store):
    two = stats(spark, [("a", 2023, 1, 1.0), ("a", 2023, 1, 2.0)])
    with pytest.raises(ValueError, match="two rows of one key"):
        store.merge("player_stats", two, KEYS)
    assert store.read("player_stats").count() == 0
    store.merge("player_stats", two.withColumn("_t", -F.col("points")), KEYS, order="_t")
    assert [r.points for r in store.read("player_stats").collect()] == [1.0]
    with pytest.raises(ValueError, match="partitioned by"):
        store.merge("player_stats", two.limit(1), ["player_id"])


def test_writers_that_race_lose_no_update(spark, store, tmp_path):
    other = CommitLog(spark, str(tmp_path / "store"))
    a, b = store.log.begin(), other.begin()
    a.merge("player_stats", stats(spark, [("a", 2023, 1, 1.0)]), KEYS)
    b.merge("player_stats", stats(spark, [("b", 2023, 1, 2.0)]), KEYS)
    b.commit()
    with pytest.raises(Conflict):
        a.commit()
    assert [r.player_id for r in store.read("player_stats").collect()] == ["b"]
    tries = []

    def work(tx):
        tries.append(tx.base)
        if len(tries) == 1:  # another writer comes in between
            other.transact(lambda t: t.merge("player_stats", stats(spark, [("c", 2023, 1, 3.0)]), KEYS))
        tx.merge("player_stats", stats(spark, [("a", 2023, 1, 1.0)]), KEYS)

    store.log.transact(work)
    assert len(tries) == 2 and sorted(r.player_id for r in store.read("player_stats").collect()) == ["a", "b", "c"]


def test_tables_change_together_or_not_at_all(spark, store):
    def fails(tx):
        tx.merge("player_stats", stats(spark, [("a", 2023, 1, 1.0)]), KEYS)
        tx.set_meta("x", "1")
        raise OSError("killed")

    with pytest.raises(OSError):
        store.log.transact(fails)
    assert store.read("player_stats").count() == 0 and store.meta("x") is None
    store.merge("player_stats", stats(spark, [("a", 2022, 1, 1.0)]), KEYS)
    old = store.read("player_stats")
    store.merge("player_stats", stats(spark, [("a", 2022, 1, 5.0)]), KEYS)
    assert [r.points for r in old.collect()] == [1.0]  # what was read stays as it was
    assert store.log.vacuum(keep=1) >= 2 and [r.points for r in store.read("player_stats").collect()] == [5.0]
    names = store.log.files.names("_commits")
    assert len(names) == 1 and json.loads(store.log.files.read(f"_commits/{names[0]}"))["meta"]["schema_version"] == "2"
    with pytest.raises(ValueError, match="aren't to be replaced"):
        store.log.transact(lambda tx: tx.replace("player_stats", stats(spark, [("a", 2021, 1, 1.0)]), [(2022,)]))
    with pytest.raises(KeyError):
        store.read("nothing")


def test_a_model_comes_back_as_it_was(spark, sf, store):
    s = models.states(spark, sf).persist()
    model = attribution.fit_boosted_value(s, rounds=3)
    one = store.save_model("value", model)
    assert store.save_model("value", attribution.fit_boosted_value(s, rounds=3)) == one  # the same model, fitted again
    two = store.save_model("value", attribution.fit_boosted_value(s, rounds=4))
    assert two != one
    with pytest.raises(ValueError, match="no model of value in production"):
        store.load_model("value")
    store.promote("value", one)
    pick = lambda m: sorted(tuple(r) for r in m.transform(s).select("drive_id", "play_id", "prediction").collect())
    assert pick(store.load_model("value")) == pick(model)
    assert pick(store.load_model("value", two)) != pick(model)
    store.promote("value", two)
    assert store.rollback("value") == one and store.production("value") == one
    s.unpersist()
