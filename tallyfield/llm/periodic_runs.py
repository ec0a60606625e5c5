"""Runs of words that repeat with a period, by suffix automata with merged end positions.

A run is a maximal stretch of consecutive words with smallest period q and at least
max(6, 4 q) words.

Seeds. A suffix automaton of the words has one state for each set of end positions; sets of
the states are merged up the suffix links, the smaller into the larger, in order of position.
Where two positions become neighbours in the set of a state of length m, the m words that
end at both are the longest that do. A distance d of at most m / 3 makes these words and the
d between them a stretch of m + d >= 4 d words with period d, a square's square, that no word
before it extends. It is a run if the word behind it doesn't continue the period either; a
smaller period of the same stretch makes neighbours of the same state, so the least distance
found for a stretch is its smallest period. Each run of four periods is found: the set of its
longest words holds its end and the position one period before, and nothing in between.

What is left out before. In a run every three consecutive words occur three times or more,
so a document is cut where three words occur less often in the stretch they are in, until
nothing changes; runs lie within what is left, whole. The counting is one sort for all
stretches of a slice of documents.

Nulls and odd input: a null text has no words, no runs and the empty string's hashes; rows
with a null id are not remade (see ``remade``), those with repeated ids each are a document;
very long texts are taken whole; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import mix64, slices, split_words, string_array, task

LEAST, PERIODS = 6, 4  # words of a run, and whole periods in it
GRAM, TIMES = 3, 3  # so many consecutive words of a run occur so often in it at least
_BLOCK = 512


class Positions:
    """Ascending integers in blocks; an insertion gives the neighbours of the new one."""

    __slots__ = ("size", "blocks", "heads")

    def __init__(self, x: int) -> None:
        self.size, self.blocks, self.heads = 1, [[x]], [x]

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int | None, int | None]:
        self.size += 1
        i = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[i]
        at = bisect_right(block, x)
        before = block[at - 1] if at else None
        after = block[at] if at < len(block) else self.heads[i + 1] if i + 1 < len(self.heads) else None
        block.insert(at, x)
        if not at:
            self.heads[i] = x
        if len(block) > _BLOCK:
            half = block[_BLOCK // 2 :]
            del block[_BLOCK // 2 :]
            self.blocks.insert(i + 1, half)
            self.heads.insert(i + 1, half[0])
        return before, after


def suffix_automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of every state, and the state of every prefix."""
    moves: list[dict[int, int]] = [{}]
    link, longest, prefix = [-1], [0], []
    last = 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = moves[at][symbol]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                split = len(moves)
                moves.append(moves[to].copy())
                longest.append(longest[at] + 1)
                link.append(link[to])
                link[to] = link[new] = split
                while at >= 0 and moves[at].get(symbol) == to:
                    moves[at][symbol] = split
                    at = link[at]
        prefix.append(new)
        last = new
    return link, longest, prefix


def runs_of(symbols: list[int]) -> dict[tuple[int, int], int]:
    """Smallest period of every run, by its start and the place behind its end."""
    n = len(symbols)
    if n < LEAST:
        return {}
    link, longest, prefix = suffix_automaton(symbols)
    sets: list[Positions | None] = [None] * len(link)
    for end, state in enumerate(prefix):
        sets[state] = Positions(end)
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(link)), key=longest.__getitem__, reverse=True):
        mine, sets[state] = sets[state], None
        above = link[state]
        m = longest[above]
        if m < LEAST - 1:  # a run's longest words that recur are as many at least
            continue
        large = sets[above]
        if large is None:
            sets[above] = mine
            continue
        if mine.size > large.size:
            mine, large = large, mine
        far = m // (PERIODS - 1)
        last = None
        for x in mine:
            before, after = large.add(x)
            # two of the smaller set were neighbours before
            for low, high in ((None if before == last else before, x), (x, after)):
                if low is None or high is None or high - low > far:
                    continue
                d = high - low
                if m + d >= LEAST and (high + 1 == n or symbols[high + 1] != symbols[high + 1 - d]):
                    stretch = (low - m + 1, high + 1)
                    found[stretch] = min(d, found.get(stretch, d))
            last = x
        sets[above] = large
    return found


def dense_stretches(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches in which every GRAM words occur TIMES times or more."""
    n = len(codes) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none
    c = codes.astype(np.uint64) + np.uint64(1)
    gram = mix64(mix64(mix64(c[:n]) + c[1 : n + 1]) + c[2 : n + 2])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[:n] == owner[GRAM - 1 :])
    stretch = owner[at].astype(np.uint64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        key = gram[at] + mix64(stretch + np.uint64(1))
        o = np.argsort(key)
        new = np.concatenate(([True], key[o[1:]] != key[o[:-1]]))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(o)))
        often = np.empty(len(o), bool)
        often[o] = np.repeat(sizes >= TIMES, sizes)
        # stretches of neighbours that stay, and of those the ones that lost nothing
        kept = np.flatnonzero(often)
        if not len(kept):
            break
        head = np.flatnonzero(np.concatenate(([True], (np.diff(at[kept]) != 1) | (stretch[kept[1:]] != stretch[kept[:-1]]))))
        tail = np.append(head[1:], len(kept))
        had = np.bincount(stretch.astype(np.int64))
        long = tail - head >= LEAST - GRAM + 1
        whole = (tail - head == had[stretch[kept[head]].astype(np.int64)]) & long
        start = at[kept[head]]
        done.append((start[whole], start[whole] + (tail - head)[whole] + GRAM - 1))
        again = long & ~whole
        size = (tail - head)[again]
        at = np.repeat(start[again], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        stretch = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    starts, ends = (np.concatenate([none, *x]) for x in (zip(*done) if done else ([], [])))
    o = np.argsort(starts)
    return starts[o], ends[o]


def remade(doc_ids: list, bounds: np.ndarray) -> np.ndarray:
    """Which word stands at each place: by the crc32 of its id, one document in ten is made
    periodic from some word on."""
    index = np.arange(bounds[-1])
    for i, doc_id in enumerate(doc_ids):
        n = int(bounds[i + 1] - bounds[i])
        if doc_id is None or not n:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            index[bounds[i] + a : bounds[i + 1]] = bounds[i] + a + np.arange(n - a) % p
    return index


_FIELDS = [pa.field("doc_id", pa.int64()), *(pa.field(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli"))]
_FIELDS += [pa.field("runs_sha256", pa.string()), pa.field("collapsed_sha256", pa.string()), pa.field("collapsed", pa.large_string())]
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(doc_ids: list, texts: pa.Array, remake: bool) -> pa.RecordBatch:
    flat, bounds = split_words(texts)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    if remake:
        index = remade(doc_ids, bounds)
        codes = codes[index]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in doc_ids]
    drop = np.zeros(len(codes) + 1, np.int32)
    for a, b in zip(*(x.tolist() for x in dense_stretches(codes, bounds))):
        doc = int(np.searchsorted(bounds, a, side="right")) - 1
        for (x, y), q in runs_of(codes[a:b].tolist()).items():
            runs[doc].append((a + x - int(bounds[doc]), y - x, q))
            drop[a + x + q] += 1
            drop[a + y] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    words = flat.take(pa.array(index[kept])) if remake else flat.filter(pa.array(kept))
    ends = np.concatenate(([0], np.cumsum(kept)))[bounds]
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), words), pa.scalar(" ", pa.large_string()))
    out: list[list] = [[] for _ in range(7)]
    for found, text in zip(runs, joined.to_pylist()):
        found.sort(key=lambda r: (r[0], r[2]))
        best = None
        for r in found:  # in order, so of equal exponents the first stays
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        for column, value in zip(out, (len(found), *row, _digest(listed), _digest(text))):
            column.append(value)
    arrays = [pa.array(doc_ids, pa.int64()), *(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5]), pa.array(out[6]), joined]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(_FIELDS))


def periodic_runs(docs: DataFrame, remake: bool = False) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period and a thousand
    times the exponent), hashes of all runs and of the collapsed text, and that text.

    ``remake`` first makes one document in ten periodic (``remade``).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _rows(part.column("doc_id").to_pylist(), string_array(part.column("text")), remake)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(task(work), SCHEMA)
