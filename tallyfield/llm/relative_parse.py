"""Removal of words that repeat an earlier document's, by relative Lempel-Ziv parsing.

A word goes if a window of ``LENGTH`` words of its document that covers it also starts in a
document of a smaller id; all windows are judged on the input.

Parsing. A reference block is indexed by the hash of every window; of equal windows the
index keeps that of the least document. A text is parsed greedily against it: at a place that
is found, the words of text and reference are compared from there on, and the longest match is
a factor, at least ``LENGTH`` words that stand in an earlier document; a place that isn't
found is a literal. Behind a factor parsing goes on with the windows that cross its end
(they may stand elsewhere in the reference), so no window is passed over between two
factors. All texts of a block are parsed together, one factor each at a step.

Blocks. Each slice of documents is first a block of its own, so of copies within a slice only
the first goes further. Windows that found nothing are dealt by the least hash of their grams
of ``GRAM`` words (equal windows have the same): neighbours with the same least gram are a
unit. Units whose gram stands in one document only are done. The others meet in blocks that
hold whole grams, as words, and are parsed there. A gram with more than ``HOT`` units (one
passage in very many different surroundings) is divided further, by window: each of its windows
goes under its own 64-bit hash, with 64 more bits to tell it by, and the first of equals is
kept while the stream passes, so no group is held. That is the one place where words are
compared by 128 bits of hashes.

Factors meet their documents by row, and their words are left out.

Nulls and odd input: a null text counts as empty; a text of fewer than LENGTH words keeps them
all; a null id is smaller than every other; rows of the same id are documents of their own,
none earlier than the other; very long texts are taken whole; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import drop_dir, mix64, slices, split_words, staged, staged_at, string_array, task, with_row_id
from tallyfield.llm.repeats import merged

LENGTH = 50
GRAM = 8
HOT = 2000  # units of a gram that are parsed in one block; a bound on what a task holds
TOGETHER = 15_000  # units parsed at a time
SLICE_MB = 8
_NO_ID = -(2**63)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd


def word_values(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per word a code (equal words, equal codes) and a hash that is the same in every task."""
    d = flat.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    return codes, hashes[codes] if len(hashes) else np.zeros(0, np.uint64)


class Hashes:
    """Hashes of any number of consecutive words, from prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, which: int = 0) -> None:
        base = _BASES[which]
        n = len(values)
        powers = np.full(n + 1, base, np.uint64)
        self.back = np.full(n + 1, pow(base, -1, 2**64), np.uint64)
        powers[0] = self.back[0] = 1
        powers = np.multiply.accumulate(powers)
        self.back = np.multiply.accumulate(self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((mix64(values ^ np.uint64(base)) if which else values) * powers[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, words: int) -> np.ndarray:
        return mix64((self.sums[start + words] - self.sums[start]) * self.back[start])


def window_starts(bounds: np.ndarray) -> np.ndarray:
    """Places at which a whole window of one text starts."""
    windows = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
    skipped = np.repeat(bounds[:-1] - (np.cumsum(windows) - windows), windows)
    return skipped + np.arange(windows.sum())


def common_words(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are the same, at most ``most``, for each pair."""
    out = np.zeros(len(a), np.int64)
    live, step = np.arange(len(a)), np.arange(64)
    while len(live):
        off = out[live][:, None] + step
        inside = off < most[live][:, None]
        same = inside & (codes[np.where(inside, a[live][:, None] + off, 0)] == codes[np.where(inside, b[live][:, None] + off, 0)])
        whole = same.all(axis=1)
        out[live] += np.where(whole, len(step), same.argmin(axis=1))
        live = live[whole]
    return out


def parse(codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of all texts of a block relative to those of smaller documents.

    ``starts`` and ``hashes`` are places and hashes of the windows, ``doc`` the document of
    each text. Returns half-open spans, in no order.
    """
    none = np.zeros(0, np.int64)
    o = np.argsort(hashes)
    again = hashes[o[1:]] == hashes[o[:-1]] if len(o) else np.zeros(0, bool)
    o = o[np.concatenate((again, [False])) | np.concatenate(([False], again))] if len(o) else o
    if not len(o):
        return none, none
    text = np.searchsorted(bounds, starts[o], side="right") - 1
    by = np.lexsort((starts[o], doc[text], hashes[o]))
    o, text = o[by], text[by]
    h = hashes[o]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    earlier = doc[text[lead]] < doc[text]
    place, reference, group = starts[o[earlier]], starts[o[lead[earlier]]], lead[earlier]
    by = np.argsort(place)
    place, reference, group = place[by], reference[by], group[by]
    text = np.searchsorted(bounds, place, side="right") - 1

    spans: list[tuple[np.ndarray, np.ndarray]] = []
    head = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else none
    tail = np.append(head[1:], len(text))
    while len(head):
        a, b = place[head], reference[head]
        end_b = bounds[np.searchsorted(bounds, b, side="right")]
        n = common_words(codes, a, b, np.minimum(bounds[text[head] + 1] - a, end_b - b))
        for i in np.flatnonzero(n < LENGTH):  # another window has the same hash: ask all of them
            others = starts[o[group[head[i]] :][: np.searchsorted(h[group[head[i]] :], h[group[head[i]]], side="right")]]
            owner = np.searchsorted(bounds, others, side="right") - 1
            others = others[doc[owner] < doc[text[head[i]]]]
            owner = np.searchsorted(bounds, others, side="right")
            n[i] = common_words(codes, np.full(len(others), a[i]), others, np.minimum(bounds[text[head[i]] + 1] - a[i], bounds[owner] - others)).max(initial=0)
        found = n >= LENGTH
        spans.append((a[found], a[found] + n[found]))
        head = np.searchsorted(place, np.where(found, a + n - LENGTH + 1, a + 1))
        more = head < tail
        head, tail = head[more], tail[more]
    return tuple(np.concatenate([none, *x]) for x in zip(*spans)) if spans else (none, none)


def unmatched(starts: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which windows lie in no factor."""
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, a, 1)
    np.add.at(inside, b - LENGTH + 1, -1)
    return np.cumsum(inside)[starts] == 0


def units(starts: np.ndarray, bounds: np.ndarray, h: Hashes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first window and number of windows of every unit of the given windows."""
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    gram = h.of(np.arange(n - GRAM + 1), GRAM)
    # the place in the low bits: the leftmost of equal grams is the least
    low = np.uint64((1 << n.bit_length()) - 1)
    least, size = (gram & ~low) | np.arange(len(gram), dtype=np.uint64), 1
    reach = LENGTH - GRAM + 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    at = (np.minimum(least[starts], least[starts + reach - size]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(starts) != 1))))
    # neighbouring windows of two texts aren't one behind the other: LENGTH - 1 words lie between
    return gram[at[first]].view(np.int64), starts[first], np.diff(np.append(first, len(starts)))


_UNIT = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
_UNIT_SQL = "key long, row long, doc long, start int, windows int"


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of what a slice of documents doesn't decide, and its factors (windows = -words)."""
    for batch in batches:
        for part in slices(batch, megabytes=SLICE_MB):
            flat, bounds = split_words(string_array(part.column("text")))
            row, doc = part.column("row").to_numpy(), part.column("doc").to_numpy()
            starts = window_starts(bounds)
            if not len(starts):
                continue
            codes, values = word_values(flat)
            h = Hashes(values)
            a, b = parse(codes, starts, h.of(starts, LENGTH), bounds, doc)
            key, start, windows = units(starts[unmatched(starts, a, b, len(codes))], bounds, h, len(codes))
            text, a, b = merged(np.searchsorted(bounds, a, side="right") - 1, a, b)
            of = np.concatenate((np.searchsorted(bounds, start, side="right") - 1, text))
            out = [np.concatenate((key, mix64(row[text].view(np.uint64)).view(np.int64))), row[of], doc[of], np.concatenate((start, a)) - bounds[of], np.concatenate((windows, a - b))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _UNIT.types)], schema=_UNIT)


_RECORD = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("words", pa.large_string())])
_RECORD_SQL = "key long, digest long, row long, doc long, start int, words string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of units, and the single windows (no words, two hashes) of units of hot grams."""
    for batch in batches:
        for part in slices(batch, megabytes=SLICE_MB / 2):
            flat, bounds = split_words(string_array(part.column("text")))
            lists = part.column("units")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            of, items = np.repeat(np.arange(len(sizes)), sizes), lists.flatten()
            key, start, windows, hot = (items.field(f).to_numpy(zero_copy_only=False) for f in ("key", "start", "windows", "hot"))
            row, doc = part.column("row").to_numpy()[of], part.column("doc").to_numpy()[of]
            at = bounds[of] + start
            u = np.flatnonzero(~hot)
            n = windows[u].astype(np.int64) + LENGTH - 1
            ends = np.concatenate(([0], np.cumsum(n)))
            index = np.repeat(at[u] - ends[:-1], n) + np.arange(ends[-1])
            words = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), flat.take(pa.array(index))), pa.scalar(" ", pa.large_string()))
            out = [key[u], np.zeros(len(u), np.int64), row[u], doc[u], start[u]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, _RECORD.types)), words], schema=_RECORD)
            u = np.flatnonzero(hot)
            if len(u):
                w = np.repeat(u, windows[u])
                off = np.arange(len(w)) - np.repeat(np.cumsum(windows[u]) - windows[u], windows[u])
                values = word_values(flat)[1]
                one, two = (Hashes(values, i).of(at[w] + off, LENGTH).view(np.int64) for i in (0, 1))
                out = [one, two, row[w], doc[w], start[w] + off]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, _RECORD.types)), pa.nulls(len(w), pa.large_string())], schema=_RECORD)


_SPAN = pa.schema([("row", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _spans(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(merged(row, a, b), _SPAN.types)], schema=_SPAN)


def _parse_block(t: pa.Table) -> pa.RecordBatch:
    flat, bounds = split_words(string_array(t["words"]))
    starts = window_starts(bounds)
    codes, values = word_values(flat)
    a, b = parse(codes, starts, Hashes(values).of(starts, LENGTH), bounds, t["doc"].to_numpy())
    unit = np.searchsorted(bounds, a, side="right") - 1
    shift = t["start"].to_numpy().astype(np.int64)[unit] - bounds[unit]
    return _spans(t["row"].to_numpy()[unit], a + shift, b + shift)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of units dealt by key and sorted by key, digest and document."""
    held: list[pa.Table] = []
    last = (0, 0, 2**63 - 1)  # key, digest and first document of a group of equal windows
    for batch in batches:
        t = pa.Table.from_batches([batch])
        single = pc.is_null(t["words"])
        w, t = t.filter(single), t.filter(pc.invert(single))
        if w.num_rows:
            key, digest, row, doc, start = (w[c].to_numpy() for c in ("key", "digest", "row", "doc", "start"))
            new = np.concatenate(([(key[0], digest[0]) != last[:2]], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
            group = np.cumsum(new)
            first = np.concatenate(([last[2]], doc[new]))[group]
            last = (int(key[-1]), int(digest[-1]), int(first[-1]))
            again = doc > first
            yield _spans(row[again], start[again].astype(np.int64), start[again].astype(np.int64) + LENGTH)
        if t.num_rows:
            held.append(t)
        if sum(x.num_rows for x in held) > TOGETHER:
            t = pa.concat_tables(held)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last gram may go on
            if cut:
                yield _parse_block(t.slice(0, cut))
            held = [t.slice(cut)]
    if held:
        yield _parse_block(pa.concat_tables(held))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(row, a, b): half-open spans of words that stand in an earlier document, staged; they
    may overlap. ``rows`` has row, doc and text."""
    done, at = staged_at(rows.select("row", "doc", "text").mapInArrow(task(_first), _UNIT_SQL), "factors")
    spans = done.where("windows < 0").select("row", F.col("start").alias("a"), (F.col("start") - F.col("windows")).alias("b"))
    open_units = done.where("windows > 0")
    shared = open_units.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = shared.select("key", (F.col("n") > HOT).alias("hot"))
    need = open_units.join(shared, "key").groupBy("row").agg(F.collect_list(F.struct("key", "start", "windows", "hot")).alias("units"))
    records = rows.select("row", "doc", "text").join(need, "row").mapInArrow(task(_records), _RECORD_SQL)
    dealt = records.repartition("key").sortWithinPartitions("key", "digest", "doc", "row", "start")
    spans = staged(spans.union(dealt.mapInArrow(task(_blocks), "row long, a int, b int")), "spans")
    drop_dir(rows.sparkSession, at)
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, megabytes=SLICE_MB):
            flat, bounds = split_words(string_array(part.column("text")))
            lists = part.column("spans")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            base, items = np.repeat(bounds[:-1], sizes), lists.flatten()
            cover = np.zeros(len(flat) + 1, np.int32)
            np.add.at(cover, base + items.field("a").to_numpy(zero_copy_only=False), 1)
            np.add.at(cover, base + items.field("b").to_numpy(zero_copy_only=False), -1)
            keep = np.cumsum(cover[:-1]) == 0
            left = np.concatenate(([0], np.cumsum(keep)))[bounds]
            kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), flat.filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))
            n = np.diff(bounds)
            digests = [hashlib.sha256(t).hexdigest() for t in kept.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n - np.diff(left)), pa.array(digests), kept], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the words that are left, joined by spaces."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_row_id(d, "row").withColumn("doc", F.coalesce("doc_id", F.lit(_NO_ID)))
    spans = repeated_spans(rows).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    whole = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(task(_cut), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
