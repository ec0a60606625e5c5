"""Play value, design triplets, Gram blocks and the ridge solve.

The design matrix exists only as (play, column, value) triplets, the normal equations as
sums keyed by (slot, column, column). Blocks add up, so a week is replaced by overwriting
its block. Only the symmetric matrix of players and teams comes to the driver, to be solved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators import gram, state_sums
from tallyfield.session import package_on_workers

PLAY = ["drive_id", "play_id"]
STATE = ["down", "ydstogo", "yardline_100"]


def state_bucket(down: Column, togo: Column, yardline: Column) -> Column:
    return (down * 10000 + F.least(F.floor(togo / 5), F.lit(9)) * 100 + F.floor(yardline / 10)).cast("long")


def cell_values(states: DataFrame) -> DataFrame:
    """Value surface by cells: mean drive points of a bucketed state."""
    b = state_bucket(F.col("down"), F.col("ydstogo"), F.col("yardline_100"))
    return states.groupBy(b.alias("bucket")).agg(F.avg("drive_points").alias("value"), F.count("*").alias("n"))


def cell_and_team_values(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cell_values`` and the mean drive points of each offence (team, strength) from one pass over
    the plays: the sums of a cell and team, which are few, are written and read twice."""
    from tallyfield.session import written

    b = state_bucket(F.col("down"), F.col("ydstogo"), F.col("yardline_100"))
    sums, _ = written(states.groupBy(b.alias("bucket"), F.col("off_team").alias("team")).agg(F.sum("drive_points").alias("p"), F.count("drive_points").alias("known"), F.count("*").alias("n")))
    mean = F.try_divide(F.sum("p"), F.sum("known"))
    return sums.groupBy("bucket").agg(mean.alias("value"), F.sum("n").alias("n")), sums.groupBy("team").agg(mean.alias("strength"))


def play_values(states: DataFrame, values: DataFrame) -> DataFrame:
    """Add v0, v1 and dv = V(next) - V(state); the last play of a drive takes its result."""
    here = F.broadcast(values.select(F.col("bucket").alias("b0"), F.col("value").alias("v0")))  # a row a bucket; plays stay where they are
    then = F.broadcast(values.select(F.col("bucket").alias("b1"), F.col("value").alias("vn")))
    s = states.withColumn("b0", state_bucket(*(F.col(c) for c in STATE))).withColumn("b1", state_bucket(*(F.col(f"n_{c}") for c in STATE)))
    s = s.join(here, "b0", "left").join(then, "b1", "left")
    s = s.withColumn("v1", F.when(F.col("terminal"), F.col("terminal_value").cast("double")).otherwise(F.coalesce("vn", "v0")))
    return s.withColumn("dv", F.col("v1") - F.col("v0")).drop("b0", "b1", "vn")


def fit_boosted_value(states: DataFrame, rounds: int = 40, depth: int = 4, rate: float = 0.08, least: int = 120):
    """Value surface by boosted trees; returns a fitted pipeline with column ``prediction``.

    Plays of one state are one row with their mean and their number as weight: squared loss asks
    for no more, so a tree's pass is over states and not over plays. ``least`` counts plays.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tallyfield.session import removed, written

    cells, at = written(states.groupBy(*STATE).agg(F.avg("drive_points").alias("drive_points"), F.count("drive_points").cast("double").alias("plays")))
    share = min(least / max(cells.agg(F.sum("plays")).first()[0] or 0.0, 1.0), 0.499)
    gbt = GBTRegressor(featuresCol="features", labelCol="drive_points", weightCol="plays", maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=1, minWeightFractionPerNode=share, seed=0)
    model = Pipeline(stages=[VectorAssembler(inputCols=STATE, outputCol="features"), gbt]).fit(cells.coalesce(1 + cells.count() // 50_000))
    removed(states.sparkSession, at)
    return model


CONDITION = 1e10  # fixed value: systems beyond it are solved by least squares


def design(plays: DataFrame, players: DataFrame, semantics: str = "oracle") -> DataFrame:
    """Triplets (drive_id, play_id, season, week, col, val): +1 offence, -1 defence, repeated
    ids add up, and a team intercept for each side. Ids outside the universe are dropped, or
    raise if ``corrected``."""
    entries = F.concat(
        F.transform("off_players", lambda p: F.struct(F.concat(F.lit("p:"), p).alias("col"), F.lit(1.0).alias("val"))),
        F.transform("def_players", lambda p: F.struct(F.concat(F.lit("p:"), p).alias("col"), F.lit(-1.0).alias("val"))),
        F.array(F.struct(F.concat(F.lit("o:"), "off_team").alias("col"), F.lit(1.0).alias("val"))),
        F.array(F.struct(F.concat(F.lit("d:"), "def_team").alias("col"), F.lit(-1.0).alias("val"))),
    )
    t = plays.select(*PLAY, "season", "week", F.explode(entries).alias("e")).select(*PLAY, "season", "week", "e.col", "e.val")
    known = players.select(F.concat(F.lit("p:"), "player_id").alias("col"))
    person = F.col("col").startswith("p:")
    if semantics == "corrected" and not t.where(person).join(known, "col", "left_anti").isEmpty():
        raise ValueError("participants outside the player universe")
    t = t.where(~person).unionByName(t.where(person).join(known, "col", "left_semi"))
    return t.groupBy(*PLAY, "season", "week", "col").agg(F.sum("val").alias("val"))


def _pair_positions(players: DataFrame, left: str, right: str | None) -> tuple[DataFrame, DataFrame]:
    """Players of both positions; ``right`` is CB if there is any in the universe, else DEF."""
    if right is None:
        right = "DEF" if players.where("position = 'CB'").isEmpty() else "CB"
    return tuple(players.where(F.col("position") == pos).select(F.col("player_id").alias(name)).distinct() for pos, name in ((left, "a"), (right, "b")))


def pair_meetings(plays: DataFrame, players: DataFrame, left: str = "WR", right: str | None = None) -> DataFrame:
    """(PLAY, a, b), a row a meeting: receivers and defenders on the field together, ids that
    stand twice as often. A play's ids meet where the play is, and only the universe is joined."""
    a, b = _pair_positions(players, left, right)
    # outer, as a plain one makes every list twice: a filter on its size goes before the plays are made
    one = plays.select(*PLAY, "def_players", F.explode_outer("off_players").alias("a")).join(a, "a")
    return one.select(*PLAY, "a", F.explode_outer("def_players").alias("b")).join(b, "b").select(*PLAY, "a", "b")


def pair_support(plays: DataFrame, players: DataFrame, left: str = "WR", right: str | None = None, least: int = 30) -> DataFrame:
    """(left player, right player) pairs that meet at least so often."""
    return pair_meetings(plays, players, left, right).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def pair_entries(plays: DataFrame, players: DataFrame, enough: DataFrame) -> DataFrame:
    """(PLAY, pairs): the interaction columns of each play, x:left|right and how often, of pairs
    with enough support. A play's pairs are few; pairs without support go before they are gathered."""
    m = pair_meetings(plays, players).join(enough.select("a", "b"), ["a", "b"]).groupBy(*PLAY, "a", "b").agg(F.count("*").alias("n"))
    entry = F.struct(F.concat(F.lit("x:"), "a", F.lit("|"), "b").alias("col"), F.col("n").cast("double").alias("val"))
    return m.groupBy(*PLAY).agg(F.collect_list(entry).alias("pairs"))


def gram_blocks(triplets: DataFrame, targets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(season, week, i, j, v) with i <= j; j null holds X'y. ``targets``: play and dv.

    The entries of one play are gathered (a play has few) and multiplied out in place, so
    the self-join on plays is one aggregation.
    """
    by = by if by is not None else ["season", "week"]
    one = triplets.groupBy(*PLAY, *by).agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("x")).join(targets.select(*PLAY, "dv"), PLAY)
    a = one.select(*by, "dv", "x", F.posexplode("x").alias("k", "a"))
    products = F.concat(
        F.transform(F.slice("x", F.col("k") + 1, F.size("x")), lambda b: F.struct(b["col"].alias("j"), (F.col("a.val") * b["val"]).alias("v"))),
        F.array(F.struct(F.lit(None).cast("string").alias("j"), (F.col("a.val") * F.col("dv")).alias("v"))),
    )
    return a.select(*by, F.col("a.col").alias("i"), F.explode(products).alias("p")).groupBy(*by, "i", F.col("p.j").alias("j")).agg(F.sum("p.v").alias("v"))


PAIRS = 100_000  # pairs with a column up to which a task knows them all, so that plays need not be shuffled


def play_gram(valued: DataFrame, players: DataFrame, by: list[str] | None = None, interactions: int = 0, plays: DataFrame | None = None) -> DataFrame:
    """The same blocks from plays that carry their participants and dv: a task multiplies the
    entries of its plays out and adds them up (``gram``), so that sums on (i, j) are shuffled
    and no products. Null ids make no entry.

    Ids outside the universe are dropped from the sums, which are small, and not from the plays.
    ``interactions``: also a column for every receiver and defender that meet so often at least;
    their products come from the same rows and go through the same sums. Up to ``PAIRS`` such
    pairs go to the tasks, more are joined to the plays. ``plays``: the same plays without their
    values, in which meetings are counted with less work.
    """
    by = by if by is not None else ["season", "week"]
    package_on_workers(valued.sparkSession)
    pairs = F.expr("cast(array() AS array<struct<col: string, val: double>>)")
    met: list[tuple[str, str]] = []
    if interactions:
        enough = pair_support(plays if plays is not None else valued, players, least=interactions).select("a", "b")
        met = [(r.a, r.b) for r in enough.limit(PAIRS + 1).collect()]  # counted once
        if len(met) > PAIRS:
            met = []
            valued = valued.join(pair_entries(valued, players, enough), PLAY, "left")
            pairs = F.coalesce("pairs", pairs)
    x = valued.select(*by, *PLAY, F.col("dv").cast("double").alias("dv"), "off_players", "def_players", F.col("off_team").cast("string").alias("off_team"), F.col("def_team").cast("string").alias("def_team"), pairs.alias("pairs"))
    if {"season", "week"} <= set(by):  # a week's sums in one task, and in one order, so that runs agree to the last bit
        x = x.repartition(*by).sortWithinPartitions(*by, *PLAY)
    x = x.drop(*PLAY)
    kinds = {f.name: f.dataType.simpleString() for f in valued.schema}
    part = x.mapInArrow(lambda batches: gram.added_up(batches, by, met), ", ".join([*(f"{k} {kinds[k]}" for k in by), "i string", "j string", "v double"]))
    return _of_universe(part.groupBy(*by, "i", "j").agg(F.sum("v").alias("v")), players)


def _of_universe(g: DataFrame, players: DataFrame) -> DataFrame:
    """Sums without those of players that the universe does not have."""
    known = players.select(F.concat(F.lit("p:"), "player_id").alias("_known")).distinct()
    for side in ("i", "j"):
        g = g.join(known, F.col(side) == F.col("_known"), "left").where(~F.coalesce(F.col(side).startswith("p:"), F.lit(False)) | F.col("_known").isNotNull()).drop("_known")
    return g


def state_gram(states: DataFrame, players: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``play_gram`` of plays valued by the means of their own cells (``cell_values``,
    ``play_values``), and the mean drive points of each offence (team, strength), from one pass
    over the states.

    The values are not known yet while plays are multiplied out; how often a column meets a cell
    is counted instead (``state_sums``). These sums, whose number doesn't grow with the plays, are
    written and read for the values, the teams and the blocks. Drive points must not be null, and a
    drive ends with its points.
    """
    from tallyfield.session import batches_by_rows, written

    by = by if by is not None else ["season", "week"]
    package_on_workers(states.sparkSession)
    here, then = (state_bucket(*(F.col(n + c) for c in STATE)) for n in ("", "n_"))
    team = lambda c: F.col(c).cast("string").alias(c)
    x = states.select(
        *by, "off_players", "def_players", team("off_team"), team("def_team"),
        here.alias("here"), F.when(here.isNotNull() & ~F.col("terminal"), F.coalesce(then, here)).alias("then"), F.col("drive_points").cast("double").alias("points"),
    )
    if {"season", "week"} <= set(by):  # a week's sums in one task
        x = x.repartition(*by)
    kinds = {f.name: f.dataType.simpleString() for f in states.schema}
    with batches_by_rows(states.sparkSession):
        sums, _ = written(x.mapInArrow(lambda batches: state_sums.added_up(batches, by), ", ".join([*(f"{k} {kinds[k]}" for k in by), state_sums.SUMS])))
    points = sums.where("i is null").select(F.col("j").alias("team"), F.explode(F.arrays_zip("cells", "weights", "plays")).alias("c")).select("team", "c.*")
    mean = F.try_divide(F.sum("weights"), F.sum("plays"))
    values = points.groupBy(F.col("cells").alias("cell")).agg(mean.alias("value")).where("cell is not null")
    met = sums.where("i is not null and j is null").select(*by, "i", F.explode(F.arrays_zip("cells", "weights")).alias("c")).select(*by, "i", F.col("c.cells").alias("cell"), "c.weights")
    met = met.join(F.broadcast(values), "cell").select(*by, "i", F.struct("cell", (F.col("weights") * F.col("value")).alias("v")).alias("c"))  # a row a cell
    rest = met.groupBy(*by, "i").agg(F.aggregate(F.sort_array(F.collect_list("c")), F.lit(0.0), lambda a, c: a + c["v"]).alias("v"))  # in one order
    parts = sums.where("i is not null").select(*by, "i", "j", "v").unionByName(rest.withColumn("j", F.lit(None).cast("string")))
    return _of_universe(parts.groupBy(*by, "i", "j").agg(F.sum("v").alias("v")), players), points.groupBy("team").agg(mean.alias("strength"))


def market_rows(strength: DataFrame, weight: float = 40.0) -> DataFrame:
    """Gram contributions (i, j, v) of one pseudo-play a team: [+1 offence, +1 defence]."""
    o, d, s = F.concat(F.lit("o:"), "team"), F.concat(F.lit("d:"), "team"), F.col("strength") * weight
    item = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), v.cast("double").alias("v"))
    none = F.lit(None).cast("string")
    w = F.lit(weight)
    return strength.select(F.explode(F.array(item(o, o, w), item(d, d, w), item(d, o, w), item(o, none, s), item(d, none, s))).alias("e")).select("e.*")


def solve_ridge(gram: DataFrame, lam: float = 120.0, prior: dict[str, float] | None = None, scale: dict[str, float] | None = None) -> dict[str, float]:
    """Ridge towards a prior mean; the symmetric matrix is the only thing collected.

    ``scale``: penalty factor of a column; team intercepts take 0.05 unless given.
    """
    rows = gram.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return solve_system({(r.i, r.j): r.v for r in rows}, lam, prior, scale)


def solve_system(sums: dict[tuple[str, str | None], float], lam: float = 120.0, prior: dict[str, float] | None = None, scale: dict[str, float] | None = None) -> dict[str, float]:
    """The solve of ``solve_ridge`` for sums of the Gram matrix by (i, j)."""
    names = sorted({i for i, _ in sums})
    at = {n: k for k, n in enumerate(names)}
    a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
    for (i, j), v in sums.items():
        if j is None:
            b[at[i]] = v
        else:
            a[at[i], at[j]] = a[at[j], at[i]] = v
    usual = {"p:": 1.0, "x:": 10.0}  # players, pairs of players; team intercepts take 0.05
    factor = lambda n: (scale or {}).get(n, usual.get(n[:2], 0.05))
    pen = lam * np.array([factor(n) for n in names])
    mean = np.array([(prior or {}).get(n, 0.0) for n in names])
    m = a + np.diag(pen)
    size = np.abs(np.linalg.eigvalsh(m)) if len(m) else np.ones(1)
    if size.max() > CONDITION * size.min():
        beta = np.linalg.lstsq(m, b + pen * mean, rcond=None)[0]
    else:
        beta = np.linalg.solve(m, b + pen * mean)
    return dict(zip(names, beta.tolist()))


def onfield_sums(plays: DataFrame, ratings: DataFrame) -> DataFrame:
    """off_sum and def_sum of ratings on the field; unrated players count 0."""
    side = lambda col, name: plays.select(*PLAY, F.explode(col).alias("player_id")).join(ratings.select("player_id", "rating"), "player_id", "left").groupBy(*PLAY).agg(F.sum(F.coalesce("rating", F.lit(0.0))).alias(name))
    return plays.select(*PLAY).join(side("off_players", "off_sum"), PLAY, "left").join(side("def_players", "def_sum"), PLAY, "left").na.fill(0.0, ["off_sum", "def_sum"])


IN_PLACE = 2000  # ratings up to which a play looks its own up, so that it need not be shuffled


def with_def_sum(plays: DataFrame, ratings: DataFrame) -> DataFrame:
    """Add ``def_sum``: the ratings of the defenders on the field, the unrated counting 0. Few
    ratings go to the plays; many meet them by joins (``onfield_sums``)."""
    few = ratings.select("player_id", F.col("rating").cast("double").alias("rating")).where("player_id is not null").limit(IN_PLACE + 1).collect()
    if len(few) > IN_PLACE:
        return plays.join(onfield_sums(plays, ratings).select(*PLAY, "def_sum"), PLAY)
    known: dict[str, float] = {}
    for r in few:
        known[r.player_id] = known.get(r.player_id, 0.0) + (r.rating or 0.0)
    one = plays.sparkSession.createDataFrame([(known,)], "_known map<string, double>")
    total = F.aggregate("def_players", F.lit(0.0), lambda a, p: a + F.coalesce(F.col("_known")[p], F.lit(0.0)))
    return plays.crossJoin(F.broadcast(one)).withColumn("def_sum", F.coalesce(total, F.lit(0.0))).drop("_known")


def fold_of(season: Column, week: Column, folds: int = 5) -> Column:
    """Fold of a week: all its plays together."""
    key = F.concat_ws("|", season.cast("string"), week.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % folds).cast("int")


def context_residual(valued: DataFrame, folds: int = 5) -> DataFrame:
    """dv less the mean of its state cell over the other folds, added as ``resid``."""
    v = valued.withColumn("_cell", state_bucket(*(F.col(c) for c in STATE))).withColumn("fold", fold_of(F.col("season"), F.col("week"), folds))
    part = v.groupBy("_cell", "fold").agg(F.sum("dv").alias("s"), F.count("dv").alias("n"))
    cell = part.groupBy("_cell").agg(F.sum("s").alias("cs"), F.sum("n").alias("cn"))
    rest = part.join(cell, "_cell").select("_cell", "fold", F.when(F.col("cn") > F.col("n"), (F.col("cs") - F.col("s")) / (F.col("cn") - F.col("n"))).otherwise(0.0).alias("g"))
    return v.join(F.broadcast(rest), ["_cell", "fold"]).withColumn("resid", F.col("dv") - F.col("g")).drop("_cell", "g")


def boosted_residual(valued: DataFrame, ratings: DataFrame, folds: int = 5, rounds: int = 200) -> DataFrame:
    """dv less what a boosted surface of the state and the defenders' rating sum says of it,
    out of fold by week; adds ``def_sum``, ``fold``, ``g`` and ``resid``.

    ``ratings`` has player_id and rating. Who is on offence is no feature, so one surface
    serves every player's credit.
    """
    from tallyfield.operators.boosting import out_of_fold
    from tallyfield.session import written

    x = with_def_sum(valued, ratings).withColumn("fold", fold_of(F.col("season"), F.col("week"), folds))
    x, _ = written(x)  # read four times: ranges, histogram, cells, rows
    return out_of_fold(x, [*STATE, "def_sum"], "dv", "fold", folds, rounds).withColumn("resid", F.col("dv") - F.col("g"))


def weekly_credit(residuals: DataFrame, least: int = 20) -> DataFrame:
    """Mean residual and snaps per offensive player and week; players under ``least`` go."""
    e = residuals.select("season", "week", "resid", F.explode(F.array_distinct("off_players")).alias("player_id"))
    weeks = e.groupBy("player_id", "season", "week").agg(F.avg("resid").alias("credit"), F.count("*").alias("snaps"))
    enough = e.groupBy("player_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return weeks.join(enough, "player_id", "left_semi")


def weekly_update(spark, valued_new: DataFrame, players: DataFrame, block_dir: str) -> DataFrame:
    """Write the Gram blocks of the new weeks over their own partitions and return all blocks.

    Running a week again replaces its block, so nothing is counted twice.
    """
    blocks = play_gram(valued_new, players)
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "week").parquet(block_dir)
    return spark.read.parquet(block_dir)
