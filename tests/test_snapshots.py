"""Season snapshots: pruning, fingerprints, drift before a read, manifests."""

import json

import pytest
from pyspark.sql import functions as F

from tallyfield import views
from tallyfield.sources import snapshots as sn


@pytest.fixture(scope="module")
def raw(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("raw") / "plays")
    df = views.raw_pbp(spark, sf).withColumn("yards", F.col("yards").cast("int"))
    sn.write(df, at)
    return df, at


def test_a_scan_reads_the_seasons_asked_for(spark, raw):
    df, at = raw
    assert sn.seasons_of(spark, at) == sorted(r.season for r in df.select("season").distinct().collect())
    got = sn.scan(spark, at, sn.RAW_PLAYS, [1996, 1998])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [season" in plan and "1996" in plan
    assert {r[0].split("season=")[1][:4] for r in got.select(F.input_file_name()).distinct().collect()} == {"1996", "1998"}
    cols = [f.name for f in sn.RAW_PLAYS] + ["season"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(map(tuple, df.where("season in (1996, 1998)").select(cols).collect()), key=repr)
    one = sn.scan(spark, at, sn.RAW_PLAYS, [1997]).select("play_id")
    assert "struct<play_id:bigint>" in one._jdf.queryExecution().executedPlan().toString()
    assert sn.source(spark, at.removesuffix("/plays"), "plays", [1996]).count() == df.where("season = 1996").count()
    with pytest.raises(FileNotFoundError, match="1801"):
        sn.scan(spark, at, sn.RAW_PLAYS, [1996, 1801])


def test_drift_is_told_before_a_read(spark, raw, tmp_path):
    df, _ = raw
    at = str(tmp_path / "plays")
    sn.write(df.where("season < 1998"), at)
    put = lambda d, s: d.where(f"season = {s}").drop("season").write.mode("append").parquet(f"file://{at}/season={s}")
    put(df.withColumn("down", F.col("down").cast("string")), 1998)
    put(df.drop("clock").withColumn("weather", F.lit("rain")), 1999)
    put(df.withColumn("weather", F.lit("sun")), 2000)
    told = {d.season: d for d in sn.drifts(spark, at, sn.RAW_PLAYS)}
    assert set(told) == {1998, 1999, 2000}
    assert told[1998].retyped == ("down: string, int",) and told[1999].absent == ("clock",) and told[2000].extra == ("weather",)
    assert [told[s].refused for s in (1998, 1999, 2000)] == [True, True, False]
    with pytest.raises(sn.SchemaDrift, match="season 1998: down: string, int; season 1999: clock absent"):
        sn.scan(spark, at, sn.RAW_PLAYS)
    assert "weather" not in sn.scan(spark, at, sn.RAW_PLAYS, [1996, 2000]).columns
    put(df.withColumn("week", F.col("week").cast("string")), 2000)  # two files of a season disagree
    with pytest.raises(sn.SchemaDrift, match="2000"):
        sn.scan(spark, at, sn.RAW_PLAYS, [2000])


def test_a_snapshot_comes_back_with_its_season_or_not_at_all(spark, sf, tmp_path):
    plays, at = views.plays(spark, sf), str(tmp_path / "snap")
    m = sn.write(plays, at)
    assert m["fingerprint"] == sn.fingerprint(plays.schema) and {"n_drives", "participation"} <= set(m["seasons"][0])
    back = sn.load(spark, at, plays.schema)
    assert back.count() == plays.count() and back.where("season is null").isEmpty()
    assert sn.load(spark, at, seasons=[1997]).select("season").distinct().collect()[0].season == 1997
    sn.write(plays.where("season = 1997").limit(10), at)  # a season again; the others stay
    assert sn.load(spark, at).count() == plays.where("season <> 1997").count() + 10
    with pytest.raises(sn.SchemaDrift, match="down"):
        sn.load(spark, at, plays.withColumn("down", F.col("down").cast("long")).schema)
    plays.where("season = 1996").drop("season").write.mode("append").parquet(f"file://{at}/season=1996")
    with pytest.raises(ValueError, match="the manifest says"):
        sn.load(spark, at)
    f = tmp_path / "snap" / sn.MANIFEST
    text = json.loads(f.read_text())
    text["schema"]["fields"][0]["type"] = "long"
    (tmp_path / "snap" / ("." + sn.MANIFEST + ".crc")).unlink(missing_ok=True)
    f.write_text(json.dumps(text))
    with pytest.raises(sn.SchemaDrift):
        sn.load(spark, at)


def test_fingerprints_ignore_order_and_season(spark):
    a = spark.createDataFrame([], "x int, y string, season int").schema
    b = spark.createDataFrame([], "y string, x int").schema
    assert sn.fingerprint(a) == sn.fingerprint(b) != sn.fingerprint(spark.createDataFrame([], "y string, x long").schema)
    assert set(sn.SOURCES) == {"plays", "rosters", "participation"}
