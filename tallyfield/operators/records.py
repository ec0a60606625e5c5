"""Output records: their vocabulary, their invariants, and the older column encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ALL, _QB, _SKILL = ("QB", "RB", "WR", "TE"), ("QB",), ("RB", "WR", "TE")
# Component, positions that may have it, unit; in the contract's order.
COMPONENTS: list[tuple[str, tuple[str, ...], str]] = [
    ("active_probability", _ALL, "probability"),
    ("start_probability", _QB, "probability"),
    ("offensive_snap_share", _SKILL, "share"),
    ("pass_attempts", _QB, "count"),
    ("completions", _QB, "count"),
    ("passing_yards", _QB, "yards"),
    ("passing_tds", _QB, "count"),
    ("interceptions", _QB, "count"),
    ("sacks_taken", _QB, "count"),
    ("rushing_attempts", _ALL, "count"),
    ("rushing_yards", _ALL, "yards"),
    ("rushing_tds", _ALL, "count"),
    ("targets", _SKILL, "count"),
    ("receptions", _SKILL, "count"),
    ("receiving_yards", _SKILL, "yards"),
    ("receiving_tds", _SKILL, "count"),
    ("fumbles_lost", _ALL, "count"),
    ("two_point_conversions", _ALL, "count"),
]
# rule, condition under which a record breaks it
RULES: dict[str, str] = {
    "comp_le_att": "comp > att",
    "rec_le_tgt": "rec > tgt",
    "probability": "p_td < 0 or p_td > 1 or isnan(p_td)",
    "quantiles": "not (q10 <= q50 and q50 <= q90)",
    "spread": "sd < 0 or isnan(sd)",
    "component": "position <> 'QB' and att > 0",
    "finite": "isnan(q10) or isnan(q50) or isnan(q90) or abs(q10) = double('infinity') or abs(q50) = double('infinity') or abs(q90) = double('infinity')",
    "inactive_zero": "p_active = 0 and (att <> 0 or comp <> 0 or tgt <> 0 or rec <> 0 or q50 <> 0)",
    "receiver": "position = 'QB' and (tgt > 0 or rec > 0)",
    "unique": "n_same > 1",
}


def component_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, p, u) for c, ps, u in COMPONENTS for p in ps], "component string, position string, unit string")


def broken(records: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """A row per record and rule that it breaks."""
    marks = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in rules.items())))
    return records.select("player_id", "season", "week", F.explode(marks).alias("rule"))


def to_legacy(states: DataFrame) -> DataFrame:
    """-1 for the state after a last play and NaN where there is no terminal value."""
    return states.withColumns({**{c: F.coalesce(c, F.lit(-1)) for c in ("n_down", "n_ydstogo", "n_yardline_100")}, "terminal_value": F.coalesce(F.col("terminal_value").cast("double"), F.lit(float("nan")))})


def from_legacy(rows: DataFrame) -> DataFrame:
    """The typed form again: sentinels and NaN become null."""
    return rows.withColumns({**{c: F.when(F.col(c) >= 0, F.col(c)) for c in ("n_down", "n_ydstogo", "n_yardline_100")}, "terminal_value": F.when(~F.isnan("terminal_value"), F.col("terminal_value").cast("int"))})
