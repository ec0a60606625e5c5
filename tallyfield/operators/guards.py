"""Guards against leakage: each is a check that raises ``LeakageError``, and catches its canary.

Forecasts are functions of named sources and an as-of point. Guards poison what such a
function must not see, look at what it absorbed, or look at its plan, which must carry the
as-of predicate down to every scan of an outcome.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.asof import AsOf, LeakageError

Sources = dict[str, DataFrame]
Forecast = Callable[[Sources, AsOf], DataFrame]


def poisoned(frame: DataFrame, at: AsOf, columns: list[str]) -> DataFrame:
    """The frame with another future: from the point on numbers are turned round and moved, and
    each such row stands once more a season later."""
    known = frame.where(at.outcome)
    later = frame.where(~at.outcome).withColumns({c: (F.lit(7) - 3 * F.col(c)).cast(frame.schema[c].dataType) for c in columns})
    again = later.withColumn("season", (F.col("season") + 1).cast(frame.schema["season"].dataType)).select(*frame.columns)
    return known.unionByName(later).unionByName(again)


CLOSE = 1e-9  # by which sums of the same numbers in another order may differ, of their size


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results have the same rows with the same multiplicity.

    Floating numbers may differ by ``CLOSE``: a mean hangs on the order in which a shuffle brings
    its rows, and that is not the same twice. All else is compared as it is.
    """
    real = [f.name for f in a.schema if f.dataType.typeName() in ("float", "double")]
    keys = [c for c in a.columns if c not in real]
    b = b.select(*a.columns)
    if not real or not keys:
        n = lambda df: df.groupBy(*[F.round(c, 9).alias(c) if c in real else c for c in df.columns]).agg(F.count("*").alias("_n"))
        x, y = n(a), n(b)
        return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
    rows = lambda df, name: df.groupBy(*(F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys))).agg(F.sort_array(F.collect_list(F.struct(*real))).alias(name))
    on = [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))]
    close = lambda p, q: p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= CLOSE * F.greatest(F.abs(p), F.abs(q), F.lit(1.0)), F.lit(False))
    pair = lambda t: functools.reduce(lambda u, w: u & w, (close(t["_a"][c], t["_b"][c]) for c in real))
    same = (F.size("_a") == F.size("_b")) & F.forall(F.arrays_zip("_a", "_b"), pair)
    return rows(a, "_a").join(rows(b, "_b"), on, "full").where(~F.coalesce(same, F.lit(False))).isEmpty()


def future_poisoning(forecast: Forecast, sources: Sources, at: AsOf, outcomes: dict[str, list[str]]) -> None:
    """G1 and G10: nothing from the point on moves a forecast, nor what was fitted for it."""
    clean = forecast(sources, at)
    for name, columns in outcomes.items():
        if not same_rows(clean, forecast({**sources, name: poisoned(sources[name], at, columns)}, at)):
            raise LeakageError(f"the future of {name} changes the forecast at season {at.season} week {at.week}")


def absorbed(slots: DataFrame, at: AsOf) -> None:
    """G2: what stands behind an origin ends before it, at the seam of seasons too."""
    last = slots.agg(F.max(F.struct("season", "week")).alias("m")).first()["m"]
    if last is not None and (last.season, last.week) >= (at.season, at.week):
        raise LeakageError(f"season {last.season} week {last.week} is absorbed before season {at.season} week {at.week}")


class Tripwire:
    """G3: a frame that is looked over at every read; undated ones are refused."""

    def __init__(self, frame: DataFrame, at: AsOf):
        at._needs(frame, "season", "week")
        self._frame, self._at = frame, at

    def add(self, rows: DataFrame) -> None:
        self._frame = self._frame.unionByName(rows)

    def read(self) -> DataFrame:
        return self._at.assert_clean(self._frame)

    def __len__(self) -> int:
        return self.read().count()


def two_paths(a: DataFrame, b: DataFrame, keys: list[str], value: str, bound: float = 1e-9) -> None:
    """G4: the offline path and the weekly one give the same numbers for the same keys."""
    x = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    bad = x.where(F.col("_a").isNull() | F.col("_b").isNull() | (F.abs(F.col("_a") - F.col("_b")) > bound))
    if (row := bad.limit(1).collect()) != []:
        raise LeakageError(f"the paths differ: {row[0].asDict()}")


def locked(frame: DataFrame, at: AsOf, lock, research: bool = False) -> DataFrame:
    """G5: rows published before the lock; for research the late ones too, and the result says so."""
    AsOf._needs(frame, "season", "week", "published_at")
    late = F.coalesce(F.col("published_at") >= F.lit(lock), F.lit(True))
    return frame.where(at.outcome & (F.lit(research) | ~late)).withColumn("research_only", F.lit(research))


def announced(events: DataFrame, at: AsOf, lock) -> DataFrame:
    """G6: interventions up to the point that were announced before the lock; a later season's
    or an undated one is an error, not a row to skip."""
    AsOf._needs(events, "season", "week", "announced_at")
    if not events.where("announced_at is null").isEmpty():
        raise LeakageError("an intervention without a date")
    if not events.where(F.col("season") > at.season).isEmpty():
        raise LeakageError(f"an intervention after season {at.season}")
    return events.where(at.pregame & (F.col("announced_at") < F.lit(lock)))


def market_at(lines: DataFrame, lock) -> DataFrame:
    """G7: each team's last line before the lock; a later one is refused."""
    AsOf._needs(lines, "team", "strength", "quoted_at")
    if not lines.where(F.coalesce(F.col("quoted_at") >= F.lit(lock), F.lit(True))).isEmpty():
        raise LeakageError("a market line from after the lock")
    return lines.groupBy("team").agg(F.max_by("strength", "quoted_at").alias("strength"))


def universe(result: DataFrame, plays: DataFrame, at: AsOf) -> None:
    """G8: nobody is rated who wasn't seen before the origin."""
    strange = result.select("player_id").distinct().join(at.slice_pool(plays), "player_id", "left_anti")
    if (row := strange.limit(1).collect()) != []:
        raise LeakageError(f"{row[0].player_id} is first seen after season {at.season} week {at.week}")


def data_version(frame: DataFrame) -> str:
    """G11: a hash of the rows in any order; a corrected row is another version."""
    r = frame.select(*sorted(frame.columns)).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"})), 1, 15), 16, 10).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}-{int(r.h or 0):x}"


def replayed(frame: DataFrame, version: str) -> DataFrame:
    """A frame that is still the version it was recorded as."""
    if (now := data_version(frame)) != version:
        raise LeakageError(f"the data are version {now}, recorded was {version}")
    return frame


def regular_only(labels: DataFrame) -> DataFrame:
    """G11: labels of the regular season; others are an error."""
    AsOf._needs(labels, "season_type")
    if not labels.where(F.coalesce(F.col("season_type") != "REG", F.lit(True))).isEmpty():
        raise LeakageError("a label from outside the regular season")
    return labels


def whole_weeks(folds: DataFrame) -> None:
    """G12: the plays of a week are in one fold."""
    if not folds.groupBy("season", "week").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty():
        raise LeakageError("a week is split between folds")


def blind_start(filtered: Callable[[DataFrame], DataFrame], series: DataFrame, column: str = "y") -> None:
    """G13: the state after a player's first week hangs on that week alone."""
    first = F.min(F.struct("season", "week")).alias("_f")
    j = series.join(series.groupBy("player_id").agg(first), "player_id")
    moved = j.withColumn(column, F.when(F.struct("season", "week") == F.col("_f"), F.col(column)).otherwise(F.col(column) + 5)).drop("_f")
    start = lambda s: filtered(s).groupBy("player_id").agg(F.min_by("x0", F.struct("season", "week")).alias("x0"))
    if not same_rows(start(series), start(moved)):
        raise LeakageError("later weeks move the first filtered state")


_SCAN = re.compile(r"FileScan \w+ .*DataFilters: \[(?P<data>.*)\], Format: .*Location: \w+\([^)]*\)?\[(?P<at>[^\]]*)\], PartitionFilters: \[(?P<parts>.*)\], PushedFilters: \[(?P<pushed>.*)\], ReadSchema")


def unguarded_scans(result: DataFrame, outcomes: list[str]) -> list[str]:
    """Scans of the outcome folders in the plan without a bound on season and week.

    The bound must have come down to the scan: as a partition's, a pushed or a row filter, or as
    the filter right above it (a bound on both where one is the partition's column).
    """
    conf = result.sparkSession.conf
    kept = conf.get("spark.sql.maxMetadataStringLength")
    conf.set("spark.sql.maxMetadataStringLength", 1 << 20)  # a long path is not to be cut off
    try:
        lines = result.select("*")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        conf.set("spark.sql.maxMetadataStringLength", kept)
    out = []
    for k, line in enumerate(lines):
        m = _SCAN.search(line)
        name = m and next((o for o in outcomes if o in m["at"]), None)
        if not name:
            continue
        filters = m["parts"] + m["pushed"] + m["data"]
        above = lines[k - 1].lstrip(" :+-") if k and len(lines[k - 1]) - len(lines[k - 1].lstrip(" :+-")) < len(line) - len(line.lstrip(" :+-")) else ""
        filters += above if above.startswith("Filter ") else ""
        bound = re.search(r"season\S* ?(<|<=|=) |(LessThan|LessThanOrEqual|EqualTo)\(season", filters)
        if not (bound and "week" in filters):
            out.append(name)
    return out
