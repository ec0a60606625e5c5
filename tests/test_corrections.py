"""The correcting stream against the batch filter, in any order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import statespace
from tallyfield.streaming.corrections import filtered_stream, last_word, run_to_end

COLS = "player_id string, position string, season int, week int, y double, snaps double, event boolean, revision long"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    final, sent = {}, []
    for i, pos in enumerate(["QB", "RB", "WR", "K"]):
        for w in range(1, 9):
            y = None if rng.random() < 0.2 else rng.gauss(0.3, 0.4)
            row = (f"x{i}", pos, 2022 + w // 5, w, y, float(rng.randrange(30)), w == 4, 3)
            final[row[0], row[2], row[3]] = row
            sent.append(row)
            if rng.random() < 0.5:  # a wrong figure, told before or after what corrects it
                sent.append((*row[:4], 9.0, 1.0, not row[6], 1))
            if rng.random() < 0.3:
                sent.append(row)
    rng.shuffle(sent)
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = filtered_stream(spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(src))
    for k in range(3):  # three runs of the stream over one checkpoint, two batches each
        for part in (sent[k * len(sent) // 3 :][: len(sent) // 6], sent[k * len(sent) // 3 + len(sent) // 6 : (k + 1) * len(sent) // 3]):
            spark.createDataFrame(part, COLS).coalesce(1).write.mode("append").parquet(src)
        told = run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert told.count() > len(final)
    got = {(r.player_id, r.season, r.week): r for r in last_word(told).collect()}
    batch = spark.createDataFrame(list(final.values()), COLS).withColumn("played", F.col("y").isNotNull())
    want = statespace.filtered(batch, semantics="corrected").collect()
    assert len(got) == len(want) == len(final)
    for r in want:
        g = got[r.player_id, r.season, r.week]
        for c in [*statespace.STATE, "pred", "var"]:
            assert g[c] == pytest.approx(r[c], abs=1e-10), c


def test_a_batch_costs_a_player_one_read_and_one_write():
    from pyspark.sql import Row

    from tallyfield.streaming.corrections import WeeklyFilter

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Value()

    f = WeeklyFilter()
    f.init(Handle())
    rows = [Row(player_id="x", position="QB", season=2022, week=w, y=0.1 * w, snaps=20.0, event=False, revision=1) for w in range(1, 31)]
    late = list(f.handleInputRows(("x",), iter(rows[5:]), None)) + list(f.handleInputRows(("x",), iter(rows[:5]), None))
    assert calls == ["get", "update"] * 2 and len(late) == 25 + 30
    once = list(f.handleInputRows(("x",), iter(rows), None))
    assert once == [] and calls[-1] == "get"  # replays
    g = WeeklyFilter()
    g.init(Handle())
    assert [r[4:] for r in g.handleInputRows(("x",), iter(rows), None)] == [r[4:] for r in late[25:]]
