"""Ridge systems solved where the sums are: by conjugate gradients, without a dense matrix.

One large system stays a table of entries. A step of the distributed solver joins it with the
vector (Spark broadcasts that while it is small, and shuffles both by column beyond), adds up
per row, and brings six numbers to the driver. Many systems that grow from slot to slot are
dealt to tasks in stretches of slots: a stretch gets the sums of all earlier slots once and
the blocks of its own, and each solve starts from the last one's solution.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyfield.session import package_on_workers, removed, written

PENALTY = {"p:": 1.0, "x:": 10.0}  # fixed values: players, pairs; team intercepts take TEAM
TEAM = 0.05


def penalty_factor(col: Column) -> Column:
    out = F.lit(TEAM)
    for prefix, factor in PENALTY.items():
        out = F.when(col.startswith(prefix), factor).otherwise(out)
    return out


def numbered(df: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values of a column and their places in byte order, from 0.

    Values are dealt by range and counted per partition; the only thing collected is one
    count a partition, so no task sees all of them.
    """
    d = df.select(col).distinct().repartitionByRange(col).sortWithinPartitions(col)
    d, _ = written(d.withColumn("_part", F.spark_partition_id()))
    before, starts = 0, []
    for r in d.groupBy("_part").agg(F.count("*").alias("n"), F.min(col).alias("lo")).orderBy("lo").collect():
        starts.append((r["_part"], before))
        before += r["n"]
    start = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(col)) - 1
    return d.join(start, "_part").select(col, (F.col("_start") + within).cast("int").alias(name))


@dataclass
class Solution:
    """Ratings (col, rating), and how the solver got there."""

    ratings: DataFrame
    columns: int
    entries: int
    steps: int
    residual: float  # of the solution, relative to the right-hand side, computed anew
    converged: bool
    history: list[float] = field(default_factory=list)  # relative residual before each step

    def report(self) -> dict:
        return {"columns": self.columns, "entries": self.entries, "steps": self.steps, "residual": self.residual, "converged": self.converged}


def conjugate_gradient(gram: DataFrame, lam: float = 120.0, prior: DataFrame | None = None, scale: DataFrame | None = None, tol: float = 1e-10, steps: int = 1000) -> Solution:
    """Ridge towards a prior mean from Gram sums (i, j, v), j null for X'y, by conjugate
    gradients with the diagonal as preconditioner.

    ``prior`` (col, mean) and ``scale`` (col, factor of the penalty) may leave columns out.
    Stops when the residual is under ``tol`` times the right-hand side, or after ``steps``. Each
    step writes the vectors (five numbers a column) and the scalars come with that write.
    """
    spark = gram.sparkSession
    sums, sums_at = written(gram.groupBy("i", "j").agg(F.sum("v").alias("v")))
    names = numbered(sums, "i", "k")
    diagonal = sums.where("i = j").select(F.col("i").alias("col"), F.col("v").alias("d"))
    right = sums.where("j is null").select(F.col("i").alias("col"), F.col("v").alias("b"))
    c = names.withColumnRenamed("i", "col").join(diagonal, "col", "left").join(right, "col", "left")
    for given, name in ((prior, "mean"), (scale, "factor")):
        c = c.join(given.select("col", name), "col", "left") if given is not None else c.withColumn(name, F.lit(None).cast("double"))
    pen = F.lit(lam) * F.coalesce("factor", penalty_factor(F.col("col")))
    zero = F.lit(0.0)
    c = c.select("col", "k", (F.coalesce("d", zero) + pen).alias("d"), (F.coalesce("b", zero) + pen * F.coalesce("mean", zero)).alias("b"))
    columns, columns_at = written(c)
    n, entries = columns.count(), sums.where("j is not null").count()
    at = columns.select("col", "k")
    off = sums.where("i < j").join(at.toDF("i", "a"), "i").join(at.toDF("j", "b"), "j").select("a", "b", "v")
    both = F.explode(F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("at")), F.struct(F.col("b").alias("row"), F.col("a").alias("at"))))
    matrix, matrix_at = written(off.select(both.alias("e"), "v").select("e.row", "e.at", "v").repartition("at"))

    def product(vector: DataFrame, name: str) -> DataFrame:
        """A times a column of ``vector``: the diagonal in place, the rest joined and added up."""
        rest = matrix.join(vector.select(F.col("k").alias("at"), F.col(name).alias("_p")), "at").groupBy("row").agg(F.sum(F.col("v") * F.col("_p")).alias("_q"))
        return vector.join(rest, vector["k"] == rest["row"], "left").withColumn("q", F.col("d") * F.col(name) + F.coalesce("_q", zero)).drop("row", "_q")

    state = columns.select("k", "d", zero.alias("x"), F.col("b").alias("r"), (F.col("b") / F.col("d")).alias("p"))
    norm = math.sqrt(columns.agg(F.sum(F.col("b") * F.col("b"))).first()[0] or 0.0)
    history: list[float] = []
    last = None
    r, p, q, d = (F.col(x) for x in "rpqd")
    scalars = {"pq": p * q, "rz": r * r / d, "zq": r * q / d, "qq": q * q / d, "rr": r * r}
    while norm:
        seen = Observation()
        now, now_at = written(product(state, "p").observe(seen, *(F.sum(v).alias(k) for k, v in scalars.items())))
        s = seen.get
        if last:
            removed(spark, last)
        last = now_at
        history.append(math.sqrt(s["rr"]) / norm)
        if history[-1] < tol or len(history) > steps or not s["pq"]:
            state = now
            break
        alpha = s["rz"] / s["pq"]
        beta = max(s["rz"] - 2 * alpha * s["zq"] + alpha * alpha * s["qq"], 0.0) / s["rz"]
        step = now.withColumn("x", F.col("x") + alpha * p).withColumn("r", r - alpha * q)
        state = step.withColumn("p", r / d + beta * p).drop("q")
    left = product(state.select("k", "d", "x"), "x").join(columns.select("k", "b"), "k").agg(F.sum(F.pow(F.col("b") - q, 2))).first()[0] if norm else 0.0
    residual = math.sqrt(left) / norm if norm else 0.0
    ratings, _ = written(columns.select("col", "k").join(state.select("k", F.col("x").alias("rating")), "k").select("col", "rating"))
    for x in (sums_at, columns_at, matrix_at, last):
        if x:
            removed(spark, x)
    return Solution(ratings, n, entries, max(len(history) - 1, 0), residual, not history or history[-1] < tol, history)


DENSE = 2000  # columns up to which a system is solved on the driver, in 32 MB


def ridge_ratings(gram: DataFrame, lam: float = 120.0, prior: DataFrame | None = None, scale: DataFrame | None = None, dense: int = DENSE) -> DataFrame:
    """Ratings (col, rating) of one system: a small one on the driver, others by conjugate
    gradients, so that no more than ``dense`` squared sums are ever collected."""
    from tallyfield.operators.attribution import solve_system

    gram, at = written(gram.groupBy("i", "j").agg(F.sum("v").alias("v")))  # read twice
    if gram.select("i").distinct().count() > dense:
        ratings = conjugate_gradient(gram, lam, prior, scale).ratings
        removed(gram.sparkSession, at)
        return ratings
    sums = {(r.i, r.j): r.v for r in gram.collect()}
    removed(gram.sparkSession, at)
    given = lambda df, name: {r["col"]: r[name] for r in df.collect()} if df is not None else None
    beta = solve_system(sums, lam, given(prior, "mean"), given(scale, "factor"))
    return gram.sparkSession.createDataFrame(sorted(beta.items()), "col string, rating double")


def sparse_ridge(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, b: np.ndarray, start: np.ndarray, tol: float = 1e-13, steps: int = 5000) -> np.ndarray:
    """The same for one system inside a task: entries of one triangle with the diagonal."""
    n = len(b)
    on = rows == cols
    diagonal = np.bincount(rows[on], vals[on], n)
    i, j = np.concatenate((rows[~on], cols[~on])), np.concatenate((cols[~on], rows[~on]))
    o = np.argsort(i, kind="stable")
    i, j, v = i[o], j[o], np.concatenate((vals[~on], vals[~on]))[o]
    times = lambda x: diagonal * x + np.bincount(i, v * x[j], n)
    x = start.copy()
    r = b - times(x)
    z = r / diagonal
    p, rz, norm = z.copy(), r @ z, np.linalg.norm(b)
    for _ in range(steps):
        if np.linalg.norm(r) <= tol * norm:
            return x
        q = times(p)
        alpha = rz / (p @ q)
        x += alpha * p
        r -= alpha * q
        z = r / diagonal
        rz, old = r @ z, rz
        p = z + (rz / old) * p
    if np.linalg.norm(b - times(x)) > 1e-9 * norm:
        raise ArithmeticError("conjugate gradients didn't converge; raise the penalty")
    return x


def stretches(blocks: DataFrame, slots: list[tuple[int, int]], origins: list[tuple[int, int]], size: int) -> DataFrame:
    """(stretch, slot, i, j, v): for each stretch of ``size`` origins the sums of all slots
    before its first origin (slot -1), and the blocks up to its last.

    A sum reaches its later stretches from one list of at most as many numbers as there are
    stretches; blocks themselves are copied once.
    """
    number = {s: k for k, s in enumerate(slots)}
    firsts = [number[o] for o in origins[::size]]
    at = blocks.join(F.broadcast(blocks.sparkSession.createDataFrame([(*s, number[s], sum(f <= number[s] for f in firsts)) for s in slots], "season int, week int, slot int, _from int")), ["season", "week"])
    own = at.where(F.col("_from") > 0).select((F.col("_from") - 1).alias("stretch"), "slot", "i", "j", "v")
    cells = at.groupBy("i", "j", "_from").agg(F.sum("v").alias("v")).groupBy("i", "j").agg(F.collect_list(F.struct("_from", "v")).alias("_c"))
    last = len(firsts) - 1
    grown = cells.select("i", "j", "_c", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("stretch")).where(F.exists("_c", lambda c: c["_from"] <= F.col("stretch")))
    base = grown.select("stretch", F.lit(-1).alias("slot"), "i", "j", F.expr("aggregate(filter(_c, c -> c._from <= stretch), 0D, (a, c) -> a + c.v)").alias("v"))
    return own.unionByName(base)


class Entries:
    """Sums (i, j, v) that came to a task, as numbers: columns in byte order."""

    def __init__(self, t: pa.Table) -> None:
        i, j = t["i"].combine_chunks().dictionary_encode(), t["j"].combine_chunks()
        names = np.array(i.dictionary.to_pylist(), object)
        order = np.argsort(names)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        self.names, self.v = names[order], t["v"].to_numpy()
        self.row = rank[i.indices.to_numpy(zero_copy_only=False)]
        self.right = ~j.is_valid().to_numpy(zero_copy_only=False)
        place = {x: k for k, x in enumerate(self.names)}
        self.col = np.array([place[x] if x is not None else -1 for x in j.to_pylist()], np.int64)
        self.factor = np.array([next((f for k, f in PENALTY.items() if x.startswith(k)), TEAM) for x in self.names])

    def solve(self, use: np.ndarray, lam: float, start: np.ndarray) -> np.ndarray:
        """Ridge of the sums in ``use``; columns that they don't know come out as 0."""
        n = len(self.names)
        e, right = use & ~self.right, use & self.right
        pair, inverse = np.unique(self.row[e] * n + self.col[e], return_inverse=True)
        own = np.arange(n)
        rows, cols = np.concatenate((pair // n, own)), np.concatenate((pair % n, own))
        vals = np.concatenate((np.bincount(inverse, self.v[e], len(pair)), lam * self.factor))
        return sparse_ridge(rows, cols, vals, np.bincount(self.row[right], self.v[right], n), start)


def solve_by(gram: DataFrame, keys: list[str], lam: float) -> DataFrame:
    """Ratings (keys, col, rating) of one system per key, each in a task; a task holds the
    sums of its system, not its plays."""
    package_on_workers(gram.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in gram.schema if f.name in keys}

    def solve(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        e = Entries(t)
        beta = e.solve(np.ones(len(e.v), bool), lam, np.zeros(len(e.names)))
        given = [pa.array([k.as_py()] * len(beta), k.type) for k in key]
        return pa.table([*given, pa.array(e.names.tolist(), pa.string()), pa.array(beta)], [*keys, "col", "rating"])

    sums = gram.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    return sums.groupBy(*keys).applyInArrow(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", col string, rating double")


def solve_stretches(dealt: DataFrame, slots: list[tuple[int, int]], origins: list[tuple[int, int]], size: int, lam: float) -> DataFrame:
    """Ratings (season, week, col, rating) at every origin, each stretch in a task of its own.

    The columns of a system are those that its sums know; a task holds the entries of one
    system and the blocks of ``size`` slots.
    """
    package_on_workers(dealt.sparkSession)
    number = {s: k for k, s in enumerate(slots)}

    def solve(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        e, slot = Entries(t), t["slot"].to_numpy()
        beta = np.zeros(len(e.names))
        out: list[tuple] = []
        stretch = key[0].as_py()
        for origin in origins[stretch * size : (stretch + 1) * size]:
            use = slot < number[origin]
            beta = e.solve(use, lam, beta)
            known = np.zeros(len(e.names), bool)
            known[e.row[use]] = True
            out.append((np.full(known.sum(), origin[0]), np.full(known.sum(), origin[1]), e.names[known], beta[known]))
        parts = [np.concatenate(x) for x in zip(*out)]
        return pa.table([pa.array(x, k) for x, k in zip(parts, (pa.int32(), pa.int32(), pa.string(), pa.float64()))], ["season", "week", "col", "rating"])

    return dealt.groupBy("stretch").applyInArrow(solve, "season int, week int, col string, rating double")
