"""Audit of how five document filters interact: every order of applying them, per source.

Measuring. The Arrow buffer of a slice of texts is read as one byte array. A table gives each
byte its classes (part of a word, capital, symbol, start of a code point); prefix sums of the
classes at the bounds of the texts are their counts, and word starts are where the word class
begins. Each word has a hash from prefix sums of a polynomial; the hashes of a slice are
sorted by text, and neighbours with equal hashes are verified by comparing the words' bytes
eight at a time. A text in which two different words share a hash is counted again from its
words, so distinct counts are exact.

Reducing. A text's failures are bits of a mask. Equal texts are found by SHA-256: rows are
counted by digest, id, part, mask and labels, then by digest without the id, where the least
id is kept, so a text with any number of copies is a few rows before it meets its digest.
What is left of a part is one count for each of 32 masks; survivors of a set of filters are
the sum over masks without its bits, and all orders follow from those 32 sums.

Nulls and odd input: a null text counts as empty; a null source is the part of the empty one;
null ids are smaller than any other, and rows of the same id don't count as earlier than each
other; a null id has no labels; of several labels of an id any 1 counts; very long texts are
measured whole; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import mix64, slices, string_array, task, text_bytes

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5  # words, and per cent of words and of code points
SYMBOLS = b"#$%&*|"
WORD_BYTE, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8
_BYTE = np.arange(256)
CLASS = (
    WORD_BYTE * ~np.isin(_BYTE, list(b" \t\n\v\f\r"))
    + CAPITAL * ((_BYTE >= ord("A")) & (_BYTE <= ord("Z")))
    + SYMBOL * np.isin(_BYTE, list(SYMBOLS))
    + POINT * ((_BYTE & 0xC0) != 0x80)
).astype(np.uint8)
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)  # odd
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _counts(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int32 if len(flags) < 2**31 else np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds]).astype(np.int64)


def word_bounds(cls: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte behind the last, of every word; words end with their text."""
    word = (cls & WORD_BYTE).astype(bool)
    cut = np.zeros(len(word) + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False])) if len(word) else word
    return np.flatnonzero(word & (~before | cut[:-1])), np.flatnonzero(word & (~after | cut[1:])) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    powers = np.full(len(data) + 1, _STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers[:-1], out=sums[1:])
    return mix64((sums[stop] - sums[start]) * powers[len(data) - start])


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` bytes at a and at b are equal, for each pair."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    same, at, off = np.ones(len(a), bool), np.flatnonzero(length > 0), 0
    while len(at):
        drop = np.uint64(8) * np.maximum(8 - (length[at] - off), 0).astype(np.uint64)
        x = (eight[a[at] + off] ^ eight[b[at] + off]) << drop
        same[at[x != 0]] = False
        off += 8
        at = at[(x == 0) & (length[at] > off)]
    return same


def distinct_words(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of every text."""
    n = len(bounds) - 1
    at = np.searchsorted(start, bounds)
    words = np.diff(at)
    hashes = word_hashes(data, start, stop) if hashes is None else hashes
    owner = np.repeat(np.arange(n, dtype=np.uint64), words)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (owner << (np.uint64(64) - bits)) | (hashes >> bits)
    o = np.argsort(key)
    again = np.flatnonzero(key[o[1:]] == key[o[:-1]])
    x, y = o[again], o[again + 1]
    length = stop - start
    same = length[x] == length[y]
    same[same] = same_bytes(data, start[x[same]], start[y[same]], length[x[same]])
    distinct = words - np.bincount(owner[y].astype(np.int64), minlength=n)
    for t in np.unique(owner[y[~same]].astype(np.int64)):  # two words of one hash
        whole = [data[a:b].tobytes() for a, b in zip(start[at[t] : at[t + 1]], stop[at[t] : at[t + 1]])]
        distinct[t] = len(set(whole))
    return words, distinct


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of large strings."""
    data, bounds = text_bytes(texts)
    cls = CLASS[data]
    words, distinct = distinct_words(data, bounds, *word_bounds(cls, bounds))
    by_class = {name: _counts((cls & bit) != 0, bounds) for name, bit in (("capitals", CAPITAL), ("symbols", SYMBOL), ("points", POINT))}
    return {"words": words, "distinct": distinct, **by_class}


def _mask(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bits of the failed filters A to D."""
    fails = (
        m["words"] < MIN_WORDS,
        100 * m["distinct"] < MIN_DISTINCT * m["words"],
        100 * m["capitals"] > MAX_CAPITALS * m["points"],
        m["symbols"] > 0,
    )
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = string_array(part.column("text"))
            digests = [hashlib.sha256(t).digest() for t in texts.cast(pa.large_binary()).to_pylist()]
            out = [part.column("doc_id"), part.column("part"), pa.array(_mask(measure(texts)), pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of every row: bits of the filters that its text alone decides."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(task(_scan), "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): rows by failed filters, that of repeated texts included."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    rows = failures(docs).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("lo"))
    first = by_kind.groupBy("digest").agg(F.min(F.struct("lo.doc_id")).alias("first"))  # a struct: null ids come first
    unique = F.when(F.col("lo.doc_id").eqNullSafe(F.col("first.doc_id")), F.col("lo.n")).otherwise(0)
    both = by_kind.join(first, "digest").withColumn("unique", unique)
    e = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("unique").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - F.col("unique")).alias("n"))))
    split = both.select("part", "good", "toxic", split.alias("s")).select("part", "s.mask", "good", "toxic", "s.n")
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _array(values: list) -> str:
    return "array(" + ", ".join(map(repr, values)) + ")"


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from counts by mask.

    A part has at most 128 counts (32 masks, two labels). The 32 sums of survivors are arrays,
    and the 600 places of a filter in an order are looked up in them, so no table is joined.
    """
    k = len(FILTERS)
    sets = range(1 << k)

    def sums(over: list[int], which: str) -> F.Column:
        return F.expr(f"transform({_array(over)}, s -> aggregate(cells, 0L, (a, c) -> a + if({which}, c.n, 0L)))")

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    bits = [1 << f for f in range(k)]
    parts = cells.select(
        "part", sums(list(sets), "c.mask & s = 0").alias("left"), sums(list(sets), "c.mask & s = 0 AND c.good = 1").alias("left_good"),
        sums(list(sets), "c.mask & s = 0 AND c.toxic = 1").alias("left_toxic"), sums(bits, "c.mask & s > 0").alias("fails"), sums(bits, "c.mask = s").alias("only"),
    )
    # a set of m earlier filters comes before filter f in m! (k - 1 - m)! orders
    shares = []
    for b in bits:
        before = [s for s in sets if not s & b]
        orders = [factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s in before]
        shares.append(f"aggregate(zip_with({_array(before)}, {_array(orders)}, (s, w) -> w * (left[s] - left[s + {b}])), 0L, (a, x) -> a + x)")
    parts = parts.withColumn("shares", F.expr("array(" + ", ".join(shares) + ")"))
    places = [(order, step + 1, FILTERS.index(order[step]), sum(1 << FILTERS.index(x) for x in order[:step])) for order in _ORDERS for step in range(k)]
    rows = parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(places) - 1))))
    rows = rows.withColumns({name: F.expr(f"{_array(list(values))}[at]") for name, values in zip(("filter_order", "step", "f", "s"), zip(*places))})
    rows = rows.withColumn("s2", F.expr(f"s + {_array(bits)}[f]"))
    return rows.selectExpr(
        "part", "filter_order", "step", "left[s2] AS kept", "left[s] - left[s2] AS removed", "fails[f] - (left[s] - left[s2]) AS redundant", "only[f] AS unique_fails",
        "left_good[s] - left_good[s2] AS good_lost", "left_toxic[s] - left_toxic[s2] AS toxic_lost", "shares[f] AS shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(mask_counts(docs, labels))
