"""Gram sums of plays whose values are not known yet, so that plays are passed over once.

A play's dv is its drive's points, if it is the last one, plus the value of the next state less
that of its own: linear in the values of the states' cells. So beside the products of entries a
task counts how often a column meets a cell, and X'y follows from these counts and the cells'
values, which come from the same pass. All that is added up here are whole numbers, so sums
don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from tallyfield.operators.gram import HELD, Names

BITS = 20  # of a number in a key
PLAYS = 131_072  # plays taken at once
PRODUCTS = 4_000_000  # products laid out at once
DENSE = 4_000_000  # places of a sum by place; beyond, keys are sorted
MASK = (1 << BITS) - 1
SIDES = (("off_players", "p:", 1), ("def_players", "p:", -1), ("off_team", "o:", 1), ("def_team", "d:", -1))
SUMS = "i string, j string, v double, cells array<bigint>, weights array<double>, plays array<double>"


def _numbers(x: pa.Array, names: Names, prefix: str | None = None) -> np.ndarray:
    """The number of each value, -1 for null."""
    e = x.dictionary_encode()
    values = e.dictionary.to_pylist()
    number = np.append(names.of(values if prefix is None else [prefix + k for k in values]), -1)
    return number[e.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)]


def _slots(x: pa.Array, names: Names, prefix: str) -> list[np.ndarray]:
    """The first, second, ... entry of each play, -1 where it has none."""
    if not pa.types.is_list(x.type):
        return [_numbers(x, names, prefix)]
    have = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    number = _numbers(x.flatten(), names, prefix)
    out = np.full((have.max(initial=0), len(x)), -1, np.int64)
    row = np.repeat(np.arange(len(x)), have)
    out[np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have), row] = number
    return list(out)


def _counted(keys: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys there are, and how often."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    if size > DENSE:
        return np.unique(key, return_counts=True)
    n = np.bincount(key, minlength=size)
    at = np.flatnonzero(n)
    return at, n[at]


class _Held:
    """Sums by key of one or two whole numbers, merged as they grow."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.parts = names, []

    def add(self, key: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append(pa.table([pa.array(key), *(pa.array(v.astype(float)) for v in values)], ["key", *self.names]))

    def size(self) -> int:
        return sum(map(len, self.parts))

    def merged(self) -> pa.Table:
        if len(self.parts) > 1:
            t = pa.concat_tables(self.parts).group_by("key", use_threads=False).aggregate([(k, "sum") for k in self.names])
            self.parts = [t.select(["key", *(f"{k}_sum" for k in self.names)]).rename_columns(["key", *self.names])]
        return self.parts[0]


class _Sums:
    def __init__(self, by: list[str]) -> None:
        self.by = by
        self.columns, self.cells, self.teams, self.groups = Names(), Names(), Names(), Names()
        self.products, self.targets, self.met, self.points = _Held(["v"]), _Held(["v", "known"]), _Held(["v"]), _Held(["p", "n"])

    def add(self, t: pa.RecordBatch) -> None:
        slots = [(s, sign) for name, prefix, sign in SIDES for s in _slots(t[name], self.columns, prefix)]
        here, then, team = _numbers(t["here"], self.cells), _numbers(t["then"], self.cells), _numbers(t["off_team"], self.teams)
        group, kept = np.zeros(t.num_rows, np.int64), [0]
        for name in self.by:
            mine = Names()
            number = _numbers(t[name], mine)
            group = group * (len(mine.at) + 1) + number + 1
        if t.num_rows:
            _, first, group = np.unique(group, return_index=True, return_inverse=True)
            kept = self.groups.of([tuple(t[name][k].as_py() for name in self.by) for k in first.tolist()])
        points, scored = t["points"].fill_null(0.0).to_numpy(zero_copy_only=False), t["points"].is_valid().to_numpy(zero_copy_only=False)
        known = (then >= 0) | (here >= 0) & scored  # those that have a dv
        base = np.where((then < 0) & known, points, 0.0)
        width = len(slots) * (len(slots) + 1) // 2
        step = max(PRODUCTS // width, 1)
        for k in range(0, t.num_rows, step):
            s = slice(k, k + step)
            part = [(c[s], sign) for c, sign in slots]
            self._multiply(part, group[s], np.asarray(kept))
            self._target(part, group[s], np.asarray(kept), here[s], then[s], base[s], known[s])
        self._score(here, team, points, scored)

    def _multiply(self, slots: list[tuple[np.ndarray, int]], group: np.ndarray, kept: np.ndarray) -> None:
        n = len(self.columns.at) + 1  # the last one is for no entry
        of = group * (n * n)
        cols = [(np.where(c < 0, n - 1, c), sign) for c, sign in slots]
        keys: dict[int, list[np.ndarray]] = {1: [], -1: []}
        for x, (a, sign) in enumerate(cols):
            for b, other in cols[x + 1 :]:
                keys[sign * other].append(of + np.minimum(a, b) * n + np.maximum(a, b))
        own = [of + a * (n + 1) for a, _ in cols]
        for one, sign, cross in ((keys[1], 1, True), (keys[-1], -1, True), (own, 1, False)):
            at, many = _counted(one, len(kept) * n * n)
            low, high = at // n % n, at % n
            real = (low < n - 1) & (high < n - 1)
            at, low, high, v = at[real], low[real], high[real], sign * many[real]
            v = np.where(low == high, 2 * v, v) if cross else v  # an id that stands twice in a play meets itself twice
            self.products.add(kept[at // (n * n)] << (2 * BITS) | low << BITS | high, v)

    def _target(self, slots: list[tuple[np.ndarray, int]], group: np.ndarray, kept: np.ndarray, here: np.ndarray, then: np.ndarray, base: np.ndarray, known: np.ndarray) -> None:
        n, m = len(self.columns.at) + 1, len(self.cells.at) + 1
        cols = [(group * n + np.where(c < 0, n - 1, c), sign) for c, sign in slots]
        key = np.concatenate([c for c, _ in cols])
        at, place = np.unique(key, return_inverse=True)
        v = np.bincount(place, np.concatenate([sign * base for _, sign in cols]), len(at))
        have = np.bincount(place, np.tile(known, len(cols)), len(at))
        real = at % n < n - 1
        self.targets.add((kept[at // n] << BITS | at % n)[real], v[real], have[real])
        keys: dict[int, list[np.ndarray]] = {1: [], -1: []}
        for cell, way in ((np.where(known, here, -1), -1), (then, 1)):
            cell = np.where(cell < 0, m - 1, cell)
            for c, sign in cols:
                keys[way * sign].append(c * m + cell)
        for sign, one in keys.items():
            at, many = _counted(one, len(kept) * n * m)
            col, cell = at // m % n, at % m
            real = (col < n - 1) & (cell < m - 1)
            self.met.add((kept[at // (n * m)] << (2 * BITS) | col << BITS | cell)[real], sign * many[real])

    def _score(self, here: np.ndarray, team: np.ndarray, points: np.ndarray, scored: np.ndarray) -> None:
        at, place = np.unique((team + 1) << BITS | (here + 1), return_inverse=True)
        self.points.add(at, np.bincount(place, points, len(at)), np.bincount(place, scored, len(at)))

    def full(self) -> bool:
        if self.products.size() + self.met.size() > 2 * HELD:
            self.products.merged(), self.met.merged(), self.targets.merged(), self.points.merged()
        return self.products.size() + self.met.size() > HELD or max(map(len, (self.columns.at, self.cells.at, self.groups.at))) > MASK >> 1

    def told(self, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if not self.points.parts:
            return
        whose = list(self.groups.at)
        names = np.array(list(self.columns.at), object)
        order = np.argsort(names) if len(names) else np.zeros(0, np.int64)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        text = pa.array(names[order].tolist(), pa.string())

        def rows(group: np.ndarray | None, i: pa.Array, j: pa.Array, v: pa.Array, size: int, lists: list[pa.Array] | None = None) -> Iterator[pa.RecordBatch]:
            given = [pa.nulls(size, kind) if group is None else pa.array([w[k] for w in whose], kind).take(pa.array(group)) for k, kind in enumerate(kinds)]
            lists = lists or [pa.nulls(size, pa.list_(x)) for x in (pa.int64(), pa.float64(), pa.float64())]
            t = pa.table([*given, i, j, v, *lists], [*self.by, "i", "j", "v", "cells", "weights", "plays"])
            yield from t.to_batches(max_chunksize=65_536 if lists[0].null_count else 256)

        t = self.products.merged()
        key = t["key"].to_numpy()
        a, b = rank[key >> BITS & MASK], rank[key & MASK]
        yield from rows(key >> (2 * BITS), text.take(pa.array(np.minimum(a, b))), text.take(pa.array(np.maximum(a, b))), t["v"], len(key))

        def lists(key: np.ndarray, whole: np.ndarray, value: list[int | None], *numbers: np.ndarray) -> list[pa.Array]:
            """Lists of cells and numbers for each of ``whole``, which is sorted, by cell."""
            cell = pa.array(value, pa.int64()).take(pa.array(key & MASK))
            o = np.lexsort((cell.fill_null(-1).to_numpy(), key >> BITS))
            start = pa.array(np.append(np.searchsorted(key[o] >> BITS, whole), len(o)).astype(np.int32))
            return [pa.ListArray.from_arrays(start, x.take(pa.array(o))) for x in (cell, *map(pa.array, numbers))]

        t, m = self.targets.merged().sort_by("key"), self.met.merged()
        key = t["key"].to_numpy()
        cells = lists(m["key"].to_numpy(), key, list(self.cells.at), m["v"].to_numpy())
        v = pa.array(t["v"].to_numpy(), mask=t["known"].to_numpy() == 0)
        yield from rows(key >> BITS, text.take(pa.array(rank[key & MASK])), pa.nulls(len(key), pa.string()), v, len(key), [*cells, pa.nulls(len(key), pa.list_(pa.float64()))])
        p = self.points.merged()
        key = p["key"].to_numpy()
        whole = np.unique(key >> BITS)
        cells = lists(key, whole, [None, *self.cells.at], p["p"].to_numpy(), p["n"].to_numpy())
        yield from rows(None, pa.nulls(len(whole), pa.string()), pa.array([None, *self.teams.at], pa.string()).take(pa.array(whole)), pa.nulls(len(whole), pa.float64()), len(whole), cells)


def added_up(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of (by, ``SUMS``) from (by, off_players, def_players, off_team, def_team, here, then,
    points), ``then`` null on the last play of a drive; a sum can come in several parts.

    i and j given: a Gram sum. j null: of X'y the part ``v`` that needs no values, null if no play
    has a dv, and by how much the values of ``cells`` weigh in the rest. i null: points (``weights``)
    and number (``plays``) of the plays that an offence, j, has in each cell.
    """
    sums, kinds, wait = _Sums(by), [], []

    def taken() -> None:
        t = pa.Table.from_batches(wait).combine_chunks()
        wait.clear()
        for b in t.to_batches():
            sums.add(b)

    for batch in batches:
        kinds = [batch.schema.field(k).type for k in by]
        wait += [batch.slice(k, PLAYS) for k in range(0, batch.num_rows, PLAYS)]
        if sum(b.num_rows for b in wait) >= PLAYS:
            taken()
            if sums.full():
                yield from sums.told(kinds)
                sums = _Sums(by)
    if wait:
        taken()
    yield from sums.told(kinds)
