"""Boosted regression trees from counts and sums of binned features, out of fold.

Squared loss asks of the data only how many rows a cell of bins holds and what their targets
add up to. Features are binned once (at most ``BINS`` values each, edges at quantiles of a
histogram), rows become cells in one aggregation, and trees are grown on the cells, each
fold's model in a task of its own. The number of cells is bounded by the bins, not by the
rows; a task holds some thirty bytes of each. Predictions are per cell and fold, and meet the rows by an equi-join on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.session import package_on_workers

BINS = 255
CHUNK = 1 << 16  # cells in one array step
FINE = 4096  # equal parts of a feature's range, in which its quantiles are looked for


def with_bins(df: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """Add ``_b0``, ``_b1``, ... in [0, bins): a bin of every feature, nulls in bin 0.

    A feature with few values keeps them apart; else its range is cut into FINE parts that
    are merged to about equal counts. Collected are FINE counts a feature at most.
    """
    ends = df.agg(*(f(x).cast("double") for x in features for f in (F.min, F.max))).first()
    fine = []
    for k, x in enumerate(features):
        lo, hi = ends[2 * k] or 0.0, ends[2 * k + 1] or 0.0
        width = (hi - lo) / FINE or 1.0
        part = F.least(F.floor((F.col(x) - lo) / width), F.lit(FINE - 1))
        fine.append(F.when(F.col(x).isNull(), 0).otherwise(part).cast("int"))  # least() would pass over a null
    cut = df.withColumns({f"_b{k}": c for k, c in enumerate(fine)})
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_b{k}").alias("b")) for k in range(len(features)))))
    counts = np.zeros((len(features), FINE), np.int64)
    for r in cut.select(stacked.alias("e")).groupBy("e.k", "e.b").count().collect():
        counts[r.k, r.b] = r["count"]
    places = {}
    for k in range(len(features)):
        full = np.flatnonzero(counts[k])
        if len(full) <= bins:
            to = np.searchsorted(full, np.arange(FINE))
        else:
            before = np.cumsum(counts[k]) - counts[k]
            to = before * bins // max(int(counts[k].sum()), 1)
        to = np.minimum(to, bins - 1)
        places[f"_b{k}"] = F.expr(f"array({', '.join(map(str, to.tolist()))})[_b{k}]").cast("short")
    return cut.withColumns(places)


def grow(bins: np.ndarray, n: np.ndarray, s: np.ndarray, rounds: int, depth: int, rate: float, least: int, train: np.ndarray) -> np.ndarray:
    """Predictions of all cells by trees grown on those in ``train``.

    ``bins`` has a column a feature, ``n`` and ``s`` count rows and add up targets. A node is
    split where the squared error falls most, leaving ``least`` rows on both sides. Cells are
    gone through in stretches of CHUNK, so beside a few numbers a cell nothing is held.
    """
    n = np.where(train, n, 0.0)
    total = n.sum()
    if not total:
        return np.zeros(len(n))
    size, features = int(bins.max()) + 1, bins.shape[1]
    columns = [np.ascontiguousarray(bins[:, f]) for f in range(features)]
    pred = np.full(len(n), np.where(train, s, 0.0).sum() / total)
    rest = np.where(train, s, 0.0) - n * pred
    node = np.zeros(len(n), np.uint8 if depth < 8 else np.int32)
    parts = [slice(k, k + CHUNK) for k in range(0, len(n), CHUNK)]

    def moved(part: slice, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = node[part]
        right = np.zeros(len(k), bool)
        for f in np.unique(feature[feature >= 0]):
            right |= columns[f][part] > np.where(feature == f, at, size)[k]
        node[part] = 2 * k + right
        return node[part]

    for _ in range(rounds):
        node[:], nodes, split = 0, 1, None
        for _ in range(depth):
            count, value = np.zeros((features, nodes * size)), np.zeros((features, nodes * size))
            for part in parts:
                k = moved(part, *split) if split else node[part]
                first = k.astype(np.intp) * size
                for f in range(features):
                    place = first + columns[f][part]
                    count[f] += np.bincount(place, n[part], nodes * size)
                    value[f] += np.bincount(place, rest[part], nodes * size)
            count, value = (x.reshape(features, nodes, size).cumsum(2) for x in (count, value))
            best = np.zeros(nodes)
            feature, at = np.full(nodes, -1), np.zeros(nodes, np.int64)
            leaf_n, leaf_s = (np.stack((x[0, :, -1], np.zeros(nodes)), 1) for x in (count, value))
            for f in range(features):
                c, v = count[f][:, -1:], value[f][:, -1:]
                right = c - count[f]
                ok = (count[f] >= max(least, 1)) & (right >= max(least, 1))
                gain = np.where(ok, value[f] ** 2 / np.where(ok, count[f], 1) + (v - value[f]) ** 2 / np.where(ok, right, 1) - v**2 / np.maximum(c, 1), 0)
                j, every = gain.argmax(1), np.arange(nodes)
                g = gain[every, j]
                better = g > best + 1e-12 * np.abs(v[:, 0])
                best, feature, at = np.where(better, g, best), np.where(better, f, feature), np.where(better, j, at)
                for leaf, x in ((leaf_n, count[f]), (leaf_s, value[f])):
                    leaf[better] = np.stack((x[every, j], x[:, -1] - x[every, j]), 1)[better]
            split = (feature, at)
            nodes *= 2
            if (feature < 0).all():
                break
        leaf = rate * np.divide(leaf_s, leaf_n, out=np.zeros_like(leaf_s), where=leaf_n > 0).ravel()
        for part in parts:
            step = leaf[moved(part, *split)]
            pred[part] += step
            rest[part] -= n[part] * step
    return pred


def out_of_fold(df: DataFrame, features: list[str], target: str, fold: str, folds: int, rounds: int = 200, depth: int = 3, rate: float = 0.1, least: int = 150) -> DataFrame:
    """Add ``g``: the prediction of a model that saw no row of the same fold.

    One aggregation makes the cells, with counts and sums of each fold side by side; a model's
    task gets a row a cell, the sums of the other folds, and predicts the cells of its own.
    """
    package_on_workers(df.sparkSession)
    names = [f"_b{k}" for k in range(len(features))]
    binned = with_bins(df, features).withColumn("_fold", F.col(fold).cast("int"))
    y = F.col(target).cast("double")
    here = lambda k, x: F.when(F.col("_fold") == k, x)
    each = range(folds)
    cells = binned.groupBy(*names).agg(
        *(F.count(here(k, F.lit(1))).alias(f"_r{k}") for k in each), *(F.count(here(k, y)).cast("double").alias(f"_n{k}") for k in each), *(F.coalesce(F.sum(here(k, y)), F.lit(0.0)).alias(f"_s{k}") for k in each)
    )
    zero = F.lit(0.0)  # the own fold is left out of the sum, not taken off it
    others = lambda x, m: sum((F.col(f"{x}{k}") for k in each if k != m), zero)
    models = F.array(*(F.struct(F.lit(m).alias("_model"), (F.col(f"_r{m}") > 0).alias("own"), others("_n", m).alias("n"), others("_s", m).alias("s")) for m in each))
    dealt = cells.select(*names, F.explode(models).alias("m")).select(*names, "m.*").repartition(folds * 16, "_model")  # so that no two models meet in a task

    def fit(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.lexsort([t[c].to_numpy() for c in names])  # one order whatever the shuffle did
        bins = np.stack([t[c].to_numpy()[order] for c in names]).astype(np.uint8 if BINS <= 256 else np.int16).T
        own, n, s = (t[c].to_numpy()[order] for c in ("own", "n", "s"))
        del t, order
        if not own.any():
            return pa.table([pa.array([], k) for k in (pa.int32(), *(pa.int16() for _ in names), pa.float64())], ["_fold", *names, "g"])
        g = grow(bins, n, s, rounds, depth, rate, least, n > 0)[own]
        mine = (pa.array(bins[own, k].astype(np.int16)) for k in range(len(names)))
        return pa.table([pa.array(np.full(len(g), key[0].as_py(), np.int32)), *mine, pa.array(g)], ["_fold", *names, "g"])

    schema = "_fold int, " + ", ".join(f"{c} short" for c in names) + ", g double"
    scored = dealt.groupBy("_model").applyInArrow(fit, schema)
    return binned.join(scored, ["_fold", *names]).drop("_fold", *names)
