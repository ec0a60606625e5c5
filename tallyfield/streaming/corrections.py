"""The talent filter over a stream in which weeks come late, twice or corrected.

A player's weeks are kept as one value, and beside each the filter's state after it. A row of
a newer revision replaces its week; the filter then runs again from the state before the
earliest week that changed, and every week from there on is told anew. So the last word on a
week is that of the batch filter, in whatever order its rows came.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyfield.operators.statespace import START_VAR, STATE, Params
from tallyfield.session import package_on_workers

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "player_id string, season int, week int, version long, " + ", ".join(f"{k} double" for k in STATE[:-1]) + ", games int, pred double, var double"
TOLD = Row("player_id", "season", "week", "version", *STATE, "pred", "var")
START = (0.0, 0.0, 0.0, START_VAR[0], 0.0, 0.0, START_VAR[1], 0.0, START_VAR[2], 99)


def one_week(s: tuple, y: float | None, snaps: float, event: bool, p: Params) -> tuple:
    """The state after a week, its prediction and the prediction's variance."""
    x0, x1, x2, p00, p01, p02, p11, p12, p22, games = s
    a, b = p.phi, p.phi_scheme
    m = (x0, x1 * a, x2 * b)
    c = [p00 / (p.d_spike if event else p.d_steady), p01 * a, p02 * b, p11 * a * a + p.q_form * (6 if event else 1), p12 * a * b, p22 * b * b + p.q_scheme + (p.scheme_reset_var if event else 0.0)]
    games = 0 if event else games
    noise = (p.post_event_mult if games < p.post_event_games else 1.0) * p.r_scale / max(snaps, 1.0)
    h = (c[0] + c[1] + c[2], c[1] + c[3] + c[4], c[2] + c[4] + c[5])
    pred, var = sum(m), sum(h) + noise
    if y is None:
        return (*m, *c, games, pred, var)
    k = [x / var for x in h]
    at = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    c = [e - k[i] * h[j] - k[j] * h[i] + k[i] * k[j] * var for e, (i, j) in zip(c, at)]
    return (*(x + g * (y - pred) for x, g in zip(m, k)), *c, games + 1, pred, var)


WEEKS = {"slot": "int", "position": "string", "y": "double", "snaps": "double", "event": "boolean", "revision": "long"}


class WeeklyFilter(StatefulProcessor):
    """A player's weeks and the states after them are one value, an array a column, so a player
    costs a batch one read and one write however many weeks it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = [f"{k} array<{t}>" for k, t in WEEKS.items()]
        self.kept = handle.getValueState("kept", ", ".join([*columns, "states array<double>", "games array<int>", "told long"]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        weeks, states, told = {}, {}, 0
        if (kept := self.kept.get()) is not None:
            *columns, flat, games, told = kept
            weeks = {w[0]: tuple(w) for w in zip(*columns)}
            n = len(START) - 1
            states = {slot: (*flat[k * n : (k + 1) * n], games[k]) for k, slot in enumerate(columns[0])}
        first = None
        for r in rows:
            slot = r.season * 100 + r.week
            if slot in weeks and weeks[slot][5] >= r.revision:
                continue  # a replay, or older than what is known
            y = None if r.y is None or math.isnan(r.y) else r.y
            weeks[slot] = (slot, r.position, y, r.snaps, r.event, r.revision)
            first = slot if first is None else min(first, slot)
        if first is None:
            return
        slots = sorted(weeks)
        state = states[max(s for s in slots if s < first)] if slots[0] < first else START
        out = []
        for slot in slots:
            if slot < first:
                continue
            _, position, y, snaps, event, _ = weeks[slot]
            got = one_week(state, y, snaps, event, Params.of(position))
            states[slot] = state = got[:10]
            out.append(TOLD(key[0], slot // 100, slot % 100, told + 1, *got))
        columns = [list(c) for c in zip(*(weeks[s] for s in slots))]
        self.kept.update((*columns, [float(x) for s in slots for x in states[s][:-1]], [states[s][-1] for s in slots], told + 1))
        yield from out

    def close(self) -> None:
        pass


def filtered_stream(weeks: DataFrame) -> DataFrame:
    """(player_id, position, season, week, y, snaps, event, revision) in; a row for every week whose
    state changed, with a version that grows, so the row of the highest version counts."""
    package_on_workers(weeks.sparkSession)
    weeks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the operator needs it
    rows = weeks.select("player_id", "position", F.col("season").cast("int").alias("season"), F.col("week").cast("int").alias("week"), F.col("y").cast("double").alias("y"), F.col("snaps").cast("double").alias("snaps"), F.coalesce("event", F.lit(False)).alias("event"), F.col("revision").cast("long").alias("revision"))
    return rows.groupBy("player_id").transformWithState(WeeklyFilter(), OUT, "Update", "None")


def last_word(told: DataFrame) -> DataFrame:
    """The row of the highest version of each player and week."""
    pick = F.max_by(F.struct(*[c for c in told.columns if c not in ("player_id", "season", "week")]), "version")
    return told.groupBy("player_id", "season", "week").agg(pick.alias("t")).select("player_id", "season", "week", "t.*")


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Take what input there is and give all that was told so far. A batch that runs again
    writes over its own folder, so nothing is told twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(OUT).parquet(out)
