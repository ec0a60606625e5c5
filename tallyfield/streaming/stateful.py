"""A stateful stream operator: each player's scalar talent filter, carried from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyfield.session import package_on_workers

OUT = "player_id string, n long, total long, talent double, var double, last_event long"
STATE = "n long, total long, talent double, var double, last_event long"
START = (0, 0, 0.0, 1.0, -1)
NOISE = 0.5


def talent_updates(events: DataFrame) -> DataFrame:
    """(player_id, ts, event_id, value) events in; a row with the new state of every player that
    a batch touches.

    State is five numbers a player. An event id at or below the last one taken is a replay and
    changes nothing, so a batch that runs again gives the same state.
    """
    package_on_workers(events.sparkSession)

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, talent, var, last = state.get if state.exists else START
        rows = pd.concat(list(batches)).sort_values("event_id")
        for event_id, value in zip(rows["event_id"].tolist(), rows["value"].tolist()):
            if event_id <= last:
                continue
            gain = var / (var + NOISE)
            talent, var = talent + gain * (value / 20 - talent), (1 - gain) * var
            n, total, last = n + 1, total + int(value // 1), event_id
        state.update((n, total, talent, var, last))
        yield pd.DataFrame({"player_id": [key[0]], "n": [n], "total": [total], "talent": [talent], "var": [var], "last_event": [last]})

    rows = events.select("player_id", F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("player_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
