"""Sums of products of the entries of plays, made in the tasks that have the plays.

A play has few entries (participants, two teams, pairs of players); all products of two of
them are laid out as numbers, added up per Arrow batch and merged as batches pass, so a task
holds at most ``HELD`` sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BITS = 20  # of a column's number; the last one stands for the target
HELD = 1_000_000  # sums a task holds before it hands them on
ROWS = 32_768  # plays multiplied out at once


class Names:
    """Numbers of values in order of appearance."""

    def __init__(self) -> None:
        self.at: dict = {}

    def of(self, values: list) -> np.ndarray:
        return np.array([self.at.setdefault(x, len(self.at)) for x in values], np.int64)


class Pairs:
    """Pairs of players (left, right) that have a column of their own, as numbers."""

    def __init__(self, pairs: Iterable[tuple[str, str]]) -> None:
        pairs = list(pairs)
        self.left, self.right = ({x: k for k, x in enumerate(sorted({p[side] for p in pairs}))} for side in (0, 1))
        code = np.array([self.left[a] * len(self.right) + self.right[b] for a, b in pairs], np.int64)
        order = np.argsort(code)
        self.code, self.names = code[order], [f"x:{pairs[k][0]}|{pairs[k][1]}" for k in order]

    @staticmethod
    def _side(x: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the ids that are known, by row."""
        row = np.repeat(np.arange(len(x)), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        e = x.flatten().dictionary_encode()
        number = np.array([*(known.get(k, -1) for k in e.dictionary.to_pylist()), -1], np.int64)  # the last one is for nulls
        number = number[e.indices.fill_null(len(number) - 1).to_numpy(zero_copy_only=False)]
        return row[number >= 0], number[number >= 0]

    def met(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in ``names``) of every meeting, a row for each time that ids stand twice."""
        (row, a), (other, b) = self._side(batch["off_players"], self.left), self._side(batch["def_players"], self.right)
        have = np.bincount(other, minlength=batch.num_rows)
        first = np.cumsum(have) - have
        n = have[row]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = np.repeat(a, n) * len(self.right) + b[np.repeat(first[row], n) + within]
        row = np.repeat(row, n)
        if not len(self.code):
            return row[:0], code[:0]
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        kept = self.code[at] == code
        return row[kept], at[kept]


def _entries(batch: pa.RecordBatch, columns: Names, met: Pairs | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column number, value) of every entry, by row."""
    parts = []
    for field, prefix, sign in (("off_players", "p:", 1.0), ("def_players", "p:", -1.0), ("off_team", "o:", 1.0), ("def_team", "d:", -1.0), ("pairs", "", 0.0)):
        x = batch[field]
        row = np.arange(len(x))
        if pa.types.is_list(x.type):
            row = np.repeat(row, x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            x = x.flatten()
        value = np.full(len(x), sign)
        if not prefix and len(x):
            value, x = x.field("val").to_numpy(zero_copy_only=False), x.field("col")
        elif not prefix:
            continue
        known = x.is_valid().to_numpy(zero_copy_only=False)
        e = x.drop_null().dictionary_encode()
        number = columns.of([prefix + k for k in e.dictionary.to_pylist()])
        parts.append((row[known], number[e.indices.to_numpy(zero_copy_only=False)] if len(e) else np.zeros(0, np.int64), value[known]))
    if met:
        row, at = met.met(batch)
        here, at = np.unique(at, return_inverse=True)
        parts.append((row, columns.of([met.names[k] for k in here])[at], np.ones(len(row))))
    row, col, val = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], val[order]


def _products(batch: pa.RecordBatch, by: list[str], columns: Names, groups: Names, met: Pairs | None = None) -> pa.Table:
    """(key, v): the batch's sums of products, keyed by the numbers of group and both columns."""
    row, col, val = _entries(batch, columns, met)
    group = (groups.of(list(zip(*(batch[k].to_pylist() for k in by)))) if by else np.repeat(groups.of([()]), batch.num_rows)) << (2 * BITS)
    have = np.bincount(row, minlength=batch.num_rows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
    after = np.repeat(have, have) - 1 - place  # entries of the same play that follow
    a = np.repeat(np.arange(len(row)), after)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
    low, high = np.minimum(col[a], col[b]), np.maximum(col[a], col[b])
    twice = np.where(low == high, 2.0, 1.0)  # an id that stands twice in a play meets itself twice
    dv = batch["dv"]
    y = pa.array(val * dv.fill_null(0.0).to_numpy(zero_copy_only=False)[row], mask=~dv.is_valid().to_numpy(zero_copy_only=False)[row])
    key = np.concatenate((group[row[a]] | low << BITS | high, group[row] | col << BITS | col, group[row] | col << BITS | (1 << BITS) - 1))
    v = pa.chunked_array([pa.array(val[a] * val[b] * twice), pa.array(val * val), y])
    return _summed(pa.table({"key": key, "v": v}))


def _summed(t: pa.Table) -> pa.Table:
    return t.group_by("key", use_threads=False).aggregate([("v", "sum")]).select(["key", "v_sum"]).rename_columns(["key", "v"])


def added_up(batches: Iterable[pa.RecordBatch], by: list[str], pairs: Iterable[tuple[str, str]] = ()) -> Iterator[pa.RecordBatch]:
    """(by, i, j, v) with i <= j, j null for X'y, from (by, dv, off_players, def_players,
    off_team, def_team, pairs); a sum can come in several parts. ``pairs``: offensive and
    defensive players with a column for their meetings, beside those that a play brings."""
    columns, groups, held, kinds = Names(), Names(), [], None
    met = Pairs(pairs) if pairs else None

    def told() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        t = _summed(pa.concat_tables(held))
        key, names, whose = t["key"].to_numpy(), list(columns.at), list(groups.at)
        order = np.argsort(np.array(names, object)) if names else np.zeros(0, np.int64)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        names = pa.array([names[k] for k in order], pa.string())
        mask = (1 << BITS) - 1
        a, b = rank[key >> BITS & mask], key & mask
        right = b == mask
        b = np.where(right, a, rank[np.where(right, 0, b)])
        first = names.take(pa.array(np.minimum(a, b)))
        second = names.take(pa.array(np.maximum(a, b), mask=right))
        g = pa.array(key >> (2 * BITS))
        out = [pa.array([w[k] for w in whose], kind).take(g) for k, kind in enumerate(kinds)]
        v = t["v"].combine_chunks()
        yield from pa.table([*out, first, second, v], [*by, "i", "j", "v"]).to_batches(max_chunksize=65_536)
        held.clear()

    for batch in batches:
        kinds = [batch.schema.field(k).type for k in by]
        for k in range(0, batch.num_rows, ROWS):
            if len(columns.at) > 1 << (BITS - 1) or len(groups.at) > 1 << (BITS - 1):
                yield from told()
                columns, groups = Names(), Names()
            held.append(_products(batch.slice(k, ROWS), by, columns, groups, met))
        if sum(map(len, held)) > 2 * HELD:
            held[:] = [_summed(pa.concat_tables(held))]
            if len(held[0]) > HELD:
                yield from told()
    yield from told()
