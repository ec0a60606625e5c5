"""Removal of bytes that repeat an earlier string of 100 bytes, by suffix sorting.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier, in a
document of a smaller id or in the same one; all strings are judged on the input.

Dealing. A window (a string of LENGTH bytes) is filed under the least hash of its 32-byte
grams, so equal windows meet under one key. Neighbouring windows with the same least gram
form a unit; no two of them are equal, or that gram's place in them would be. Units of one key
and one 64-bit digest of their bytes are taken as equal (with the key, 128 bits): within a
batch before the shuffle, then under the key, all but the first are covered without being
sorted. Only keys with units of different digests go on, as bytes of the units.

Sorting. Units of a key that share the hash of some window are cut to the stretch of windows
whose hash occurs again and chained, in document order. A stretch with the bytes of an earlier
one of its chain (compared byte by byte) is a repeat as it stands; the others make a string, and
suffix arrays of many such strings are built together by linear grouping (``suffix_groups``).
Among suffixes that start windows, equal windows stand next to each other, and their bytes are
compared. All but the first of a run are repeats. Strings over ``CHAIN`` bytes (one string
takes as many steps as it has groups) are instead split by window: windows are sorted by hash
and compared byte by byte, which is as exact.

Covered spans meet their documents by row and are cut out.

Nulls and odd input: a null text counts as empty; fewer than LENGTH bytes never repeat; rows
with null or repeated ids are documents of their own, nulls first, equal ids in order of text;
an empty table gives an empty result; other columns are ignored. ``kept_sha256`` is of the
bytes; ``kept`` replaces a sequence broken by the cut when shown as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import drop_dir, mix64, small_batches, staged, staged_at, string_array, task, text_or_empty
from tallyfield.llm.near_dedup import map_groups
from tallyfield.llm.suffix_groups import suffix_arrays

LENGTH = 100
GRAM = 32
NEAR = (LENGTH - GRAM) // 2
CHAIN = 4096  # longest string that suffix sorting takes
TOGETHER = 1 << 19  # bytes of strings sorted at a time
BLOCK = 8  # bytes of a symbol behind the anchor
_SEED = np.arange(1, 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
TABLE = mix64(_SEED[:256])
STEP = mix64(_SEED[256:272]) | np.uint64(1)


def gram_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all grams whose lengths are the given powers of two."""
    h, n, out = TABLE[data], 1, {}
    for i in range(max(sizes).bit_length()):
        if n in sizes:
            out[n] = h
        if n == max(sizes):
            break
        h = h[:-n] * STEP[i] + h[n:] if len(h) > n else h[:0]
        n *= 2
    return out


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes at each place: parts of 64, 32 and 4 bytes."""
    n = len(data) - LENGTH + 1
    g = gram_hashes(data, (4, 32, 64))
    return mix64(g[64][:n] * STEP[10] + g[32][64 : 64 + n] * STEP[11] + g[4][96 : 96 + n])


def units_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, digest of the bytes, text, first place in the text, windows, and hashes of what
    stands left and right of the least gram, of every unit.

    A window reaches NEAR bytes past its least gram on one side at least, so two equal ones
    have the left or the right hash in common. A side cut short by the text has a hash of
    its place.
    """
    n = len(data) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return (empty,) * 7
    h = mix64(gram_hashes(data, (GRAM,))[GRAM])
    # the place in the low bits: the leftmost of equal grams is the least
    low = np.uint64((1 << len(h).bit_length()) - 1)
    least, s = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    reach = LENGTH - GRAM + 1
    while 2 * s <= reach:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    least = np.minimum(least[: n], least[reach - s : reach - s + n])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + LENGTH <= bounds[owner + 1])
    if not len(at):
        return (empty,) * 7
    gram, own = (least[at] & low).view(np.int64), owner[at]
    first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (own[1:] != own[:-1]))))
    windows = np.diff(np.append(first, len(at)))
    start = at[first]
    powers = np.full(len(data) + 1, STEP[12])
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers[:-1], out=sums[1:])
    digest = mix64((sums[start + windows + LENGTH - 1] - sums[start]) * powers[len(data) - start] + windows.astype(np.uint64))
    x, own = gram[first], own[first]
    apart = mix64(start.astype(np.uint64) + digest)
    left = np.where(x - NEAR >= bounds[own], h[np.maximum(x - NEAR, 0)], apart)
    right = np.where(x + NEAR + GRAM <= bounds[own + 1], h[np.minimum(x + NEAR, len(h) - 1)], ~apart)
    return h[x].view(np.int64), digest.view(np.int64), own, start - bounds[own], windows, left.astype(np.uint16).view(np.int16), right.astype(np.uint16).view(np.int16)


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open spans, per row; touching spans become one."""
    if not len(row):
        return row, start, stop
    o = np.lexsort((start, row))
    row, start, stop = row[o], start[o], stop[o]
    new_row = np.concatenate(([True], row[1:] != row[:-1]))
    # a running maximum of the stops that starts anew with each row
    shift = (np.cumsum(new_row) - 1) * (int(stop.max()) + 1)
    far = np.maximum.accumulate(stop + shift) - shift
    head = np.concatenate(([True], new_row[1:] | (start[1:] > far[:-1])))
    at = np.flatnonzero(head)
    return row[at], start[at], far[np.append(at[1:], len(row)) - 1]


_FIELDS = ["key", "digest", "row", "start", "windows", "left", "right"]
_UNIT = "key long, digest long, row long, start int, windows int, left short, right short"


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    columns = [*columns, *([np.zeros(len(columns[0]), np.int16)] * (len(_FIELDS) - len(columns)))]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int16()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds)], _FIELDS)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units, and covered spans (windows = -bytes) of units seen earlier in the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(0).to_numpy()
        o = np.argsort(rows, kind="stable")
        texts = string_array(batch.column(1)).take(pa.array(o))
        rows = rows[o]
        bounds = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy()))).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
        key, digest, own, start, windows, left, right = units_of(data, bounds)
        o = np.lexsort((digest, key))  # stable, so the earliest of equal units leads
        k, d = key[o], digest[o]
        lead = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(o) else np.zeros(0, bool)
        u = o[lead]
        yield _batch([key[u], digest[u], rows[own[u]], start[u], windows[u], left[u], right[u]])
        w = o[~lead]
        r, a, b = merged(rows[own[w]], start[w], start[w] + windows[w] + LENGTH - 1)
        yield _batch([mix64(r.view(np.uint64)).view(np.int64), np.zeros(len(r), np.int64), r, a, a - b])


def _under_key(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Of units under their keys: covered spans, and units that must be compared."""
    span = t["windows"].to_numpy() < 0
    key, digest, row, start, windows, left, right = (t[c].to_numpy()[~span] for c in _FIELDS)
    new_key = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    lead = new_key | np.concatenate(([True], digest[1:] != digest[:-1])) if len(key) else new_key
    no = np.cumsum(new_key) - 1
    many = np.bincount(no[lead])[no] > 1 if len(key) else new_key
    need = np.flatnonzero(lead & many)
    close = np.zeros(len(need), bool)  # the left or the right hash occurs twice under the key
    for side in (left[need], right[need]):
        o = np.lexsort((side, no[need]))
        same = (side[o][1:] == side[o][:-1]) & (no[need][o][1:] == no[need][o][:-1])
        close[o[1:][same]] = close[o[:-1][same]] = True
    need = need[close]
    r = np.concatenate((t["row"].to_numpy()[span], row[~lead]))
    a = np.concatenate((t["start"].to_numpy()[span], start[~lead])).astype(np.int64)
    b = np.concatenate((t["start"].to_numpy()[span] - t["windows"].to_numpy()[span], start[~lead] + windows[~lead] + LENGTH - 1)).astype(np.int64)
    r, a, b = merged(r, a, b)
    return _batch([np.concatenate((key[need], np.zeros(len(r), np.int64))), np.zeros(len(need) + len(r), np.int64), np.concatenate((row[need], r)), np.concatenate((start[need], a)), np.concatenate((windows[need], a - b))])


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Sizes of a column's lists of structs, and the fields of all their elements."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return sizes, *(flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)


def _bytes_of_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = string_array(batch.column("text"))
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        sizes, key, start, windows = _lists(batch.column("units"), "key", "start", "windows")
        row = np.repeat(batch.column("row").to_numpy(), sizes)
        length = windows + LENGTH - 1
        ends = np.cumsum(length)
        index = np.repeat((np.repeat(bounds[:-1], sizes) + start - (ends - length)).astype(np.int32), length)
        index += np.arange(len(index), dtype=np.int32)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(data.take(index))])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(start, pa.int32()), pa.array(windows, pa.int32()), out], ["key", "row", "start", "windows", "bytes"])


def repeated_windows(data: np.ndarray, unit_at: np.ndarray, windows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places in ``data`` of windows that equal an earlier window under their key.

    Units stand in order, key by key; unit i has the bytes from unit_at[i] and so many
    windows.
    """
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(key) else key
    none = np.zeros(0, np.int64)
    if not len(unit_at) or len(data) < LENGTH:
        return none
    at = np.repeat(unit_at - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    unit = np.repeat(np.arange(len(unit_at)), windows)
    h = window_hashes(data)[at]
    o = np.lexsort((h, group[unit]))
    same = (h[o][1:] == h[o][:-1]) & (group[unit[o]][1:] == group[unit[o]][:-1])
    if not same.any():
        return none
    # chains: units of a group with a window in common, by the least unit they reach
    link_a, link_b = unit[o][:-1][same], unit[o][1:][same]
    chain = np.arange(len(unit_at))
    while True:
        low = np.minimum(chain[link_a], chain[link_b])
        new = chain.copy()
        np.minimum.at(new, link_a, low)
        np.minimum.at(new, link_b, low)
        np.minimum.at(new, chain[link_a], low)
        np.minimum.at(new, chain[link_b], low)
        new = new[new]
        if (new == chain).all():
            break
        chain = new
    inside = np.zeros(len(unit_at), bool)
    inside[link_a] = inside[link_b] = True
    twin = np.zeros(len(at), bool)
    twin[o[:-1][same]] = twin[o[1:][same]] = True
    length = windows + LENGTH - 1
    # the anchor of a unit: the first place from its last window on with the key's gram
    g = mix64(gram_hashes(data, (GRAM,))[GRAM])
    hit = np.flatnonzero(g == np.repeat(key.view(np.uint64), length)[: len(g)])
    of = np.searchsorted(unit_at, hit, side="right") - 1
    good = hit - unit_at[of] >= windows[of] - 1
    anchor = np.zeros(len(unit_at), np.int64)
    of, at_first = np.unique(of[good], return_index=True)
    anchor[of] = hit[good][at_first] - unit_at[of]
    # of a unit only the stretch from its first to its last window with a twin is sorted
    twins = np.flatnonzero(twin)
    lead = np.flatnonzero(np.concatenate(([True], unit[twins][1:] != unit[twins][:-1])))
    mine = unit[twins[lead]]
    cut_off = np.zeros(len(unit_at), np.int64)
    cut_off[mine] = (at - unit_at[unit])[twins[lead]]
    windows = windows.copy()
    windows[mine] = at[twins[np.append(lead[1:], len(twins)) - 1]] - at[twins[lead]] + 1
    unit_at, anchor, length = unit_at + cut_off, anchor - cut_off, windows + LENGTH - 1
    # stretches of a chain with the same bytes are sorted once
    again = _same_stretches(data, np.flatnonzero(inside), unit_at, length, chain)
    inside[again] = False
    left = np.bincount(chain[inside], minlength=len(unit_at))
    inside &= left[chain] > 1  # no two windows of one unit are equal
    copies = np.repeat(unit_at[again] - (np.cumsum(windows[again]) - windows[again]), windows[again]) + np.arange(int(windows[again].sum()))
    chain_bytes = np.bincount(chain[inside], weights=length[inside] + 1, minlength=len(unit_at)).astype(np.int64)
    long = inside & (chain_bytes[chain] > CHAIN)
    split = long[unit] & twin
    out = [copies, _by_window(data, at[split], chain[unit][split], h[split])]
    todo = np.flatnonzero(inside & ~long)
    todo = todo[np.lexsort((todo, chain[todo], chain_bytes[chain[todo]]))]  # strings of like length together
    head = np.flatnonzero(np.concatenate(([True], chain[todo][1:] != chain[todo][:-1]))) if len(todo) else none
    ends = np.cumsum(length[todo] + 1)
    cut = 0
    while cut < len(head):
        stop = cut + 1
        began = ends[head[cut] - 1] if head[cut] else 0
        while stop < len(head) and ends[head[stop] - 1] - began < TOGETHER:
            stop += 1
        last = head[stop] if stop < len(head) else len(todo)
        out.append(_by_suffixes(data, todo[head[cut] : last], unit_at, anchor, windows, chain))
        cut = stop
    return np.concatenate(out)


def _same_stretches(data: np.ndarray, units: np.ndarray, start: np.ndarray, length: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Units whose bytes are those of an earlier unit of their chain: found by a hash, compared
    byte by byte."""
    if not len(units):
        return units
    powers = np.full(len(data) + 1, STEP[12])
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers[:-1], out=sums[1:])
    s, n = start[units], length[units]
    h = (sums[s + n] - sums[s]) * powers[len(data) - s]
    o = np.lexsort((units, h, n, chain[units]))
    x = (chain[units][o], n[o], h[o])
    new = np.concatenate(([True], np.any([a[1:] != a[:-1] for a in x], axis=0)))
    lead = o[np.flatnonzero(new)[np.cumsum(new) - 1]][~new]
    o = o[~new]
    if not len(o):
        return units[:0]
    ends = np.cumsum(n[o])
    off = np.arange(int(ends[-1])) - np.repeat(ends - n[o], n[o])
    unlike = data[np.repeat(s[o], n[o]) + off] != data[np.repeat(s[lead], n[o]) + off]
    return np.sort(units[o[np.add.reduceat(unlike, ends - n[o]) == 0]])


def _rows_equal(view: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), bool)
    for i in range(0, len(a), 50_000):
        out[i : i + 50_000] = (view[a[i : i + 50_000]] == view[b[i : i + 50_000]]).all(axis=1)
    return out


def _symbols(data: np.ndarray, start: np.ndarray, anchor: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of units in a row, and how many each has: bytes up to the anchor, then blocks.

    Windows start at or before the anchor, so only bytes up to there are symbols of their
    own. The anchor's gram and each BLOCK bytes behind it are one symbol, whose number goes
    by the order of the bytes. Equal windows have the anchor at the same place, so they are
    cut alike; one that ends inside a block shares the block's first bytes, and strings that
    do stand together in that order. 0 parts the units.
    """
    tail = length - anchor - GRAM
    blocks = -(-tail // BLOCK)
    n = anchor + 1 + blocks + 1
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int64)
    head = np.arange(int(anchor.sum())) - np.repeat(np.cumsum(anchor) - anchor, anchor)
    out[head + np.repeat(first, anchor)] = data[head + np.repeat(start, anchor)].astype(np.int64) + 1
    grams = np.lib.stride_tricks.sliding_window_view(data, GRAM)[start + anchor].copy().view(f"S{GRAM}").ravel()
    out[first + anchor] = np.unique(grams, return_inverse=True)[1] + 257
    shift = len(grams) + 257
    no = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = np.repeat(start + anchor + GRAM, blocks) + no * BLOCK
    stop = np.repeat(start + length, blocks)
    value = np.zeros(len(at), np.uint64)
    for k in range(BLOCK):  # big-endian, short blocks padded
        inside = at + k < stop
        value = (value << np.uint64(8)) | np.where(inside, data[np.minimum(at + k, len(data) - 1)], 0).astype(np.uint64)
    out[np.repeat(first + anchor + 1, blocks) + no] = np.unique(value, return_inverse=True)[1] + shift
    return out, n


def _by_suffixes(data: np.ndarray, units: np.ndarray, unit_at: np.ndarray, anchor: np.ndarray, windows: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Repeats among chained units, from the suffix arrays of the chains."""
    w = windows[units]
    symbols, n = _symbols(data, unit_at[units], anchor[units], w + LENGTH - 1)
    head = np.flatnonzero(np.concatenate(([True], chain[units][1:] != chain[units][:-1])))
    order = suffix_arrays(symbols, np.add.reduceat(n, head))
    # places in data of suffixes that start a window, in suffix order
    inner = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    begins = np.repeat(np.cumsum(n) - n, w) + inner
    where = np.full(len(symbols), -1, np.int64)
    where[begins] = np.repeat(unit_at[units], w) + inner
    string = np.zeros(len(symbols), np.int64)
    string[(np.cumsum(n) - n)[head[1:]]] = 1
    string = np.cumsum(string)
    order = order[where[order] >= 0]
    place = where[order]
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    equal = (string[order[1:]] == string[order[:-1]]) & _rows_equal(view, place[1:], place[:-1])
    run = np.concatenate(([0], np.cumsum(~equal)))
    least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, place)
    return place[place != least[run]]


def _by_window(data: np.ndarray, at: np.ndarray, chain: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Repeats among windows of long chains: sorted by hash, compared byte by byte."""
    if not len(at):
        return at
    o = np.lexsort((at, h, chain))
    at, h, chain = at[o], h[o], chain[o]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (chain[1:] != chain[:-1])))
    lead = at[new][np.cumsum(new) - 1]
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    same = _rows_equal(view, at, lead)
    if not same.all():  # unequal windows of one hash: leave nothing to it
        bad = np.unique((np.cumsum(new) - 1)[~same])
        fix = np.isin(np.cumsum(new) - 1, bad)
        seen: dict = {}
        for i in np.flatnonzero(fix):
            first = seen.setdefault((int(chain[i]), view[at[i]].tobytes()), int(at[i]))
            lead[i] = first
    return at[at != lead]


def _compare(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    row, start, windows = t["row"].to_numpy(), t["start"].to_numpy().astype(np.int64), t["windows"].to_numpy().astype(np.int64)
    column = t["bytes"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    length = windows + LENGTH - 1
    unit_at = np.cumsum(length) - length
    again = repeated_windows(data, unit_at, windows, t["key"].to_numpy())
    unit = np.searchsorted(unit_at, again, side="right") - 1
    a = start[unit] + again - unit_at[unit]
    r, a, b = merged(row[unit], a, a + LENGTH)
    return pa.RecordBatch.from_arrays([pa.array(r), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["row", "a", "b"])


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): rows ascend as documents do."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n, distinct = d.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == distinct:
        return d.select(F.col("doc_id").alias("row"), "doc_id", "text")
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "repeat-rows")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(row, a, b): half-open byte spans that repeat earlier text, staged; they may overlap."""
    small_batches(rows.sparkSession)
    units = rows.select("row", "text").mapInArrow(task(_units), _UNIT)
    dealt = units.repartition("key").sortWithinPartitions("key", "digest", "row", "start")
    seen, at = staged_at(map_sorted(dealt, ["key"], _under_key, _UNIT), "units")
    spans = seen.where("windows < 0").select("row", F.col("start").alias("a"), (F.col("start") - F.col("windows")).alias("b"))
    need = seen.where("windows >= 0").groupBy("row").agg(F.collect_list(F.struct("key", "start", "windows")).alias("units"))
    with_bytes = rows.select("row", "text").join(need, "row").mapInArrow(task(_bytes_of_units), "key long, row long, start int, windows int, bytes binary")
    compared = map_groups(with_bytes, ["key"], _compare, "row long, a int, b int", ["row", "start"], rows=15_000)
    spans = staged(spans.union(compared), "spans")
    drop_dir(rows.sparkSession, at)
    return spans


def map_sorted(df: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    return map_groups(df, keys, work, schema, dealt=True)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the text that is left."""
    rows = numbered(docs)
    spans = repeated_spans(rows).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            sizes, a, b = _lists(batch.column("spans"), "a", "b")
            row, a, b = merged(np.repeat(np.arange(batch.num_rows), sizes), a, b)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            spans = list(zip(a.tolist(), b.tolist()))
            for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                mine = spans[cuts[i] : cuts[i + 1]]
                kept, at = [], 0
                for x, y in mine:
                    kept.append(text[at:x])
                    at = y
                kept = b"".join([*kept, text[at:]])
                for c, x in zip(out, (len(text), len(text) - len(kept), len(mine), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(task(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
