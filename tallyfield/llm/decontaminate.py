"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Strings are sequences of words. A passage of a document within ``k = floor(EDITS * W)`` word
edits (insert, delete, replace) of an item of W words is a match; passages may start at every
word and be up to k words longer or shorter than the item.

Windows. By the q-gram lemma a match keeps at least W - 1 - 2k of the item's W - 1 word pairs,
within W + k words. Only windows at starts with so many pairs of an item in reach are embedded
for it, which loses nothing; of those, the ones that put a pair where the item has it, as others
are out of step with the item from the first word on. Pairs are looked up in runs of texts of about ``SPREAD`` rows.

Embedding. The CGK walk reads a string with a pointer: step j writes the word under the
pointer and moves on by a random bit that depends on (j, word) alone; past the end it writes
a pad. Two strings in edit distance d walk to embeddings of Hamming distance O(d^2), small
in most walks, while different ones fall apart.

Search. Each draw walks item-sized windows and items anew with its own bits and samples
``SAMPLED`` places of the embedding; a stretch of starts is a candidate for an item once one of
its windows equals the item in the sampled places of one draw. ``draws`` gives their number by
length so that at the full bound of edits a passage is found with ``RECALL`` at least, whatever
the kind of edits (a test holds deletions, one deleted block, insertions, replacements and a
mix to it). Draws go in rounds; what is found early is walked no more.

Check. From all starts of a candidate the edit distance to every beginning of the text is had
at once by bit-parallel dynamic programming (Myers) over the reversed words. Of an item's
matches in a text that of the fewest edits, then the first, is reported.

Benchmark items are read by the driver in parts of about ``PART_BYTES`` of text, each broadcast
by itself; a larger benchmark takes several passes over the documents.

Nulls and odd input: null or empty texts and items match nothing; items shorter than
``LEAST_WORDS`` words are matched whole, without edits; equal items are reported each; repeated
rows are reported each; a very long text is one row of a batch, searched whole; empty tables
give an empty result; other columns are ignored, or kept as they are by ``without_benchmark``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import coded, mix64, small_batches, split_words, staged, string_array, task, text_or_empty

EDITS = 0.2  # edits of an item's words
LEAST_WORDS = 5
SPREAD = 1_000_000  # (pair of a text, item) rows at a time
SAMPLED = 2
RECALL = 0.999
ROUND = 16  # draws between two looks at what is found
WALKED = 20_000  # windows walked at a time
PART_BYTES = 16 << 20
SEED = np.uint64(0x51ED270B35AE2C11)
PAD = np.uint64(0x2545F4914F6CDD1D)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def edit_distance_to_prefix(item: list, window: list, k: int) -> tuple[int, int]:
    """Least edits from ``item`` to a beginning of ``window``, and that beginning's length.

    Only cells within k of the diagonal are looked at; k + 1 means more than k.
    """
    n, m = len(item), len(window)
    far = k + 1
    row = [j if j <= k else far for j in range(m + 1)]
    for i in range(1, n + 1):
        lo, hi = max(0, i - k), min(m, i + k)
        new = [far] * (m + 1)
        if lo == 0:
            new[0] = min(i, far)
        for j in range(max(1, lo), hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (item[i - 1] != window[j - 1]), far)
        row = new
        if min(row) >= far:
            return far, 0
    best = min(range(m + 1), key=lambda j: (row[j], abs(j - n)))
    return row[best], best


def distances_from(item: list, words: list) -> list[int]:
    """For each start in ``words``, the least edits from ``item`` to a stretch from there on."""
    m = len(item)
    mask, last = (1 << m) - 1, 1 << (m - 1)
    same: dict = defaultdict(int)
    for j, w in enumerate(reversed(item)):
        same[w] |= 1 << j
    up, down, d = mask, 0, m  # cells one more, or one less, than the cell before
    out = []
    for w in reversed(words):
        eq = same.get(w, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(h | up), up & h
        if right & last:
            d += 1
        elif left & last:
            d -= 1
        right, left = right << 1, left << 1
        up, down = (left | ~(v | right)) & mask, right & v & mask
        out.append(d)
    return out[::-1]


def draws(width: int) -> int:
    """Draws that reach RECALL for items of so many words, in whole rounds."""
    return ROUND * (4 + width // 20) if width >= LEAST_WORDS else 1


class Walks:
    """Some draws for items of one length: their bits, and the places sampled from each."""

    def __init__(self, width: int, first: int, last: int):
        which = np.arange(first, last)
        self.salt = mix64(SEED + which.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(width))
        reach = max(1, int(1.5 * width))  # later places mostly hold pads
        self.rows = defaultdict(list)  # draws that sample a place
        for r in which.tolist():
            for j in np.random.default_rng([r, width]).choice(reach, min(SAMPLED, reach), replace=False):
                self.rows[int(j)].append(r - first)

    @np.errstate(over="ignore")
    def keys(self, h: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Per draw, the hash of the sampled places of the embedding of each h[a : b]; h ends in
        a pad."""
        salt = self.salt[:, None]
        key = np.repeat(salt, len(at), axis=1)
        place = np.repeat(at[None, :], len(self.salt), axis=0)
        for j in range(max(self.rows) + 1):
            word = np.where(place < stop, h.take(place), PAD)
            if rows := self.rows.get(j):
                key[rows] = mix64(key[rows] * np.uint64(0x9E3779B97F4A7C15) + word[rows])
            bit = mix64(word ^ (salt + np.uint64(j) * np.uint64(0xD1B54A32D192ED03))) & np.uint64(1)
            place = np.minimum(place + bit.view(np.int64), stop)
        return key


@cache
def walks(width: int, first: int, last: int) -> Walks:
    return Walks(width, first, last)


Stretch = tuple[int, int, int, int, np.ndarray]  # text, item, first and last start, starts of windows


def sampled_alike(h: np.ndarray, bounds: np.ndarray, stretches: list[Stretch], items: dict[int, np.ndarray]) -> list[Stretch]:
    """Those where a window and the item agree in the sampled places of some draw."""
    out: list[Stretch] = []
    h = np.append(h, PAD)
    by_width: dict[int, list[Stretch]] = defaultdict(list)
    for x in stretches:
        by_width[len(items[x[1]])].append(x)
    for width, todo in by_width.items():
        n = draws(width)
        for first in range(0, n, ROUND):
            w = walks(width, first, min(first + ROUND, n))
            left: list[Stretch] = []
            while todo:
                some, size = [], 0
                while todo and (not some or size < WALKED):
                    some.append(todo.pop())
                    size += len(some[-1][4])
                sizes = np.array([len(x[4]) for x in some])
                at = np.concatenate([x[4] for x in some])
                stop = np.minimum(at + width, np.repeat(bounds[[x[0] + 1 for x in some]], sizes))
                which, code = np.unique([x[1] for x in some], return_inverse=True)
                begin = np.arange(len(which)) * width
                theirs = w.keys(np.concatenate([*(items[int(i)] for i in which), [PAD]]), begin, begin + width)
                same = (w.keys(h, at, stop) == theirs[:, np.repeat(code, sizes)]).any(axis=0)
                hit = np.logical_or.reduceat(same, np.cumsum(sizes) - sizes)
                for x, good in zip(some, hit.tolist()):
                    (out if good else left).append(x)
            todo = left
            if not todo:
                break
    return out


class Items:
    """Benchmark items, and which of them hold a word pair."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.words: list[list[str]] = []
        self.hashes: list[np.ndarray] = []
        self.ids = []
        self.single: dict[int, list[int]] = defaultdict(list)  # items of one word, by its hash
        pairs, places = [], []
        for item_id, text in items:
            w = split_words(pa.array([text or ""], pa.large_string()))[0].to_pylist()
            if w:
                h = word_hashes(w)
                if len(w) == 1:
                    self.single[int(h[0])].append(len(self.ids))
                distinct, where = np.unique(pair_hashes(h[:-1], h[1:]), return_index=True)
                pairs.append(distinct)
                places.append(where)
                self.words.append(w)
                self.hashes.append(h)
                self.ids.append(item_id)
        self.seen = np.unique(word_hashes(sorted({x for w in self.words for x in w})))
        self.width = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.most = np.array([self.edits(int(w)) for w in self.width], np.int64)
        pair = np.concatenate([np.zeros(0, np.uint64), *pairs])
        holder = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
        order = np.argsort(pair, kind="stable")
        self.holder = holder[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *places])[order]  # of the pair in the item
        self.pairs, self.first = np.unique(pair[order], return_index=True)
        self.holders = np.diff(np.append(self.first, len(pair)))

    def edits(self, width: int) -> int:
        return int(EDITS * width) if width >= LEAST_WORDS else 0

    def starts(self, at: np.ndarray, pair: np.ndarray, owner: np.ndarray, bounds: np.ndarray) -> Iterator[Stretch]:
        """What the filter leaves; ``at``: places of the item pairs number ``pair``, in order.

        A stretch's windows start where the item would if one of its pairs were in its place.
        """
        n = self.holders[pair]
        total = np.cumsum(n)
        text = owner[at]
        new = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(at) else np.zeros(0, np.int64)
        run = (total - n)[new] // SPREAD  # runs of whole texts
        cuts = [*new[np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))], len(at)] if len(at) else []
        for a, b in zip(cuts, cuts[1:]):
            size = n[a:b]
            here = np.repeat(at[a:b], size)
            entry = np.repeat(self.first[pair[a:b]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            item, place, whose = self.holder[entry], self.place[entry], owner[here]
            order = np.lexsort((here, item, whose))
            here, item, whose, begin = here[order], item[order], whose[order], (here - place)[order]
            least = self.width[item] - 1 - 2 * self.most[item]  # pairs that a match keeps
            reach = self.width[item] + self.most[item] - 2
            end = np.arange(len(here)) + least - 1
            inside = np.minimum(end, len(here) - 1)
            good = (end < len(here)) & (whose[inside] == whose) & (item[inside] == item) & (here[inside] - here <= reach)
            begun = np.flatnonzero(good)
            inside, high, item, whose, reach = inside[good], here[good], item[good], whose[good], reach[good]
            if not len(high):
                continue
            low = np.maximum(here[inside] - reach, bounds[whose])
            lead = np.flatnonzero(np.concatenate(([True], (whose[1:] != whose[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1] + 1))))
            last = np.append(lead[1:], len(high)) - 1
            for t, i, x, y, p, q in zip(whose[lead].tolist(), item[lead].tolist(), low[lead].tolist(), high[last].tolist(), begun[lead].tolist(), inside[last].tolist()):
                yield t, i, x, y, np.unique(np.clip(begin[p : q + 1], x, y))

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits) of the best match of each item in a text."""
        flat, bounds = split_words(texts)
        if not len(flat) or not self.words:
            return []
        codes, words = coded(flat)
        own = word_hashes(words)
        h = own[codes]
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        near = np.isin(own, self.seen)[codes]  # words of some item
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        if self.single:
            for a in np.flatnonzero(np.isin(own, np.fromiter(self.single, np.uint64, len(self.single)))[codes]).tolist():
                for i in self.single[int(h[a])]:
                    found.setdefault((int(owner[a]), i), (a, 1, 0))
        some = np.flatnonzero(near[:-1] & near[1:] & (owner[:-1] == owner[1:]))
        pair = pair_hashes(h[some], h[some + 1])
        if len(self.pairs):
            number = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            held = self.pairs[number] == pair
            stretches = list(self.starts(some[held], number[held], owner, bounds))
            hashes = {x[1]: self.hashes[x[1]] for x in stretches}
            for t, i, low, high, _ in sampled_alike(h, bounds, stretches, hashes):
                k, item = int(self.most[i]), self.words[i]
                stop = min(high + len(item) + k, int(bounds[t + 1]))
                part = [words[c] for c in codes[low:stop]]
                d = distances_from(item, part)[: high - low + 1]
                least = min(d)
                a = low + d.index(least)
                if least <= k and ((t, i) not in found or (least, a) < (found[t, i][2], found[t, i][0])):
                    found[t, i] = (a, edit_distance_to_prefix(item, part[a - low : a - low + len(item) + k], k)[1], least)
        return [(t, i, a - int(bounds[t]), n, d) for (t, i), (a, n, d) in sorted(found.items())]


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) + b


def load_items(benchmark: DataFrame) -> Iterator[Items]:
    """The items, in parts of about PART_BYTES of text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    for p in range(parts):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else rows
        yield Items(sorted((tuple(r) for r in some.collect()), key=str))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words and edits of each item found in a document."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, first_word long, n_words long, edits long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def found(items: Items) -> DataFrame:
        held = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                ids = batch.column(0)
                rows = [(ids[t].as_py(), items.ids[i], a, n, d) for t, i, a, n, d in items.matches(string_array(batch.column(1)))]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "first_word", "n_words", "edits"])

        return rows.mapInArrow(task(search), schema)

    out = None
    for items in load_items(benchmark):
        out = found(items) if out is None else out.union(found(items))
    return spark.createDataFrame([], schema) if out is None else out


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; every column as it was."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")

    def cleaned(docs: DataFrame, items: Items) -> DataFrame:
        held = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in items.matches(string_array(batch.column(at)))]] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(task(keep), docs.schema)

    for n, items in enumerate(load_items(benchmark)):
        docs = cleaned(staged(docs, "decontaminated") if n else docs, items)
    return docs
