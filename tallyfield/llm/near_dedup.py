"""Near-duplicate documents by DartMinHash signatures, banded joining and exact checks.

A document is the set of its shingles of five words, each of weight 1 however often it
occurs, so signatures follow the similarity that defines a link. Every element has a stream of
darts, fixed by its hash: for each unit of weight and each unit of rank, a Poisson(1) number
of them at hashed places. A document owns the darts that fall below its weight and below a
rank bound of about (K ln K + 2K) / total weight; each dart belongs to one of K coordinates,
and the earliest dart of a coordinate is its signature there (a coordinate left empty doubles
the bound). Two documents agree in a coordinate with their Jaccard similarity as probability.
(``dart_signatures`` itself takes repeated elements too, as weights 1 + ln(times)).

Equal texts are one node. Signatures are cut into bands; nodes that share a band are
candidates. Within a band bucket pairs are not enumerated into the plan: round one emits a
spanning forest of the most similar pairs by signature, checked exactly (Jaccard similarity
of the shingle sets, ``LEAST`` or more) on the texts, and components are formed. Round two
takes only families (nodes that buckets connect) that still hold several components and
checks every pair across components whose signatures agree enough, so no link is lost to the
forest; it returns only links that join components. Buckets are worked in blocks of ``BLOCK``
nodes, families in pairs of blocks, so none is gathered.

A pair of similarity 0.8 shares a band with probability 0.9996; signatures of such a pair
agree below ``AGREE`` with probability under 1e-3.

Nulls and odd input: a null text counts as empty; equal texts, empty ones too, are one class;
a text of one to four words has one shingle, all of it; a document's class is the least
doc_id of it, null only if it has none; repeated rows get a row each; an empty table gives an
empty result; a very long text is one node like any other, its shingles all counted; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import coded, mix64, small_batches, split_words, staged, string_array, task, text_or_empty, uniform, unused, with_row_id
from tallyfield.llm.components import connected_components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
K = BANDS * ROWS
AGREE = 0.66
BLOCK = 512
# cumulative Poisson(1) probabilities
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 16.0)))))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and for each the index of its text."""
    flat, bounds = split_words(texts)
    n = np.diff(bounds)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, words = coded(flat)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[codes]
    owner = np.repeat(np.arange(len(texts)), n)
    sums = np.zeros(len(h), np.uint64)
    for j in range(SHINGLE):
        sums[: len(h) - j] += h[j:] * _ODD[j]
    left = np.repeat(bounds[1:], n) - np.arange(len(h))  # words from here to the text's end
    whole = left >= SHINGLE
    out, who = mix64(sums[whole]), owner[whole]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        extra = []
        for i in short:
            part = h[bounds[i] : bounds[i + 1]]
            extra.append((part * _ODD[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part)))
        out, who = np.concatenate((out, mix64(np.array(extra, np.uint64)))), np.concatenate((who, short))
    return out, who


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, and for each the index of its text."""
    h, who = shingle_hashes(texts)
    if not len(h):
        return h, who
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    keep = np.concatenate(([True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])))
    return h[keep], who[keep]


def dart_signatures(h: np.ndarray, who: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """(n, k) dart hashes; rows of texts without shingles are zero."""
    signature = np.zeros((n, k), np.uint64)
    if not len(h):
        return signature
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    first = np.concatenate(([True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])))
    at = np.flatnonzero(first)
    weight = 1.0 + np.log(np.diff(np.append(at, len(h))))
    h, who = h[at], who[at]
    total = np.bincount(who, weights=weight, minlength=n)
    # a cell is one unit of weight of one element
    cells = np.ceil(weight).astype(np.int64)
    cell_h = np.repeat(h, cells)
    cell_no = np.arange(len(cell_h)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell_h = mix64(cell_h + (cell_no.astype(np.uint64) + np.uint64(1)) * _ODD[0])
    cell_w = np.repeat(weight, cells) - cell_no
    cell_who = np.repeat(who, cells)

    todo = np.unique(who)
    bound = np.zeros(n)
    bound[todo] = (k * np.log(k) + 2 * k) / total[todo]
    best_rank = np.full(n * k, np.inf)
    best = np.zeros(n * k, np.uint64)
    done_to = np.zeros(n, np.int64)  # units of rank already thrown
    while len(todo):
        ranks, places, ids = [], [], []
        live = np.zeros(n, bool)
        live[todo] = True
        mine = np.flatnonzero(live[cell_who])
        top = np.ceil(bound).astype(np.int64)
        unit = done_to.copy()
        while len(mine):
            w = cell_who[mine]
            uh = mix64(cell_h[mine] ^ ((unit[w].astype(np.uint64) + np.uint64(1)) * _ODD[1]))
            count = np.searchsorted(_POISSON, uniform(uh), side="right")
            hit = np.flatnonzero(count)
            c = count[hit]
            src = np.repeat(hit, c)
            no = np.arange(len(src)) - np.repeat(np.cumsum(c) - c, c)
            dart = mix64(uh[src] + (no.astype(np.uint64) + np.uint64(1)) * _ODD[2])
            below = uniform(mix64(dart ^ _ODD[3])) < cell_w[mine][src]
            src, dart = src[below], dart[below]
            ranks.append(unit[w[src]] + uniform(mix64(dart ^ _ODD[4])))
            places.append(w[src] * k + (dart % np.uint64(k)).astype(np.int64))
            ids.append(dart)
            unit[todo] += 1
            mine = mine[unit[w] < top[w]]
        done_to[todo] = np.maximum(top[todo], done_to[todo])
        rank, place, dart = np.concatenate(ranks), np.concatenate(places), np.concatenate(ids)
        order = np.lexsort((dart, rank, place))
        rank, place, dart = rank[order], place[order], dart[order]
        lead = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
        rank, place, dart = rank[lead], place[lead], dart[lead]
        better = rank < best_rank[place]
        best_rank[place[better]], best[place[better]] = rank[better], dart[better]
        empty = (best_rank.reshape(n, k)[todo] == np.inf).any(axis=1)
        todo = todo[empty]
        bound[todo] = 2 * np.ceil(bound[todo])
    return best.reshape(n, k)


def signature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, one hash a band and one byte a coordinate."""
    small_batches(docs.sparkSession, 400)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_array(batch.column(2))
            h, who = shingle_sets(texts)
            sig = dart_signatures(h, who, len(texts))
            some = np.zeros(len(texts), bool)
            some[who] = True
            parts = sig.reshape(-1, BANDS, ROWS)
            keys = np.zeros((len(texts), BANDS), np.uint64)
            for j in range(ROWS):
                keys = mix64(keys + parts[:, :, j])
            keys = mix64(keys + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _ODD[0]).view(np.int64)
            sizes = np.where(some, BANDS, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(keys[some].ravel()))
            small = (mix64(sig) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands, pa.array([x.tobytes() for x in small], pa.binary())], ["doc_id", "t", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text_or_empty().cast("binary"))).alias("t"), text_or_empty().alias("text"))
    return rows.mapInArrow(task(sign), "doc_id long, t binary, bands array<long>, sig binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, K)


def map_groups(df: DataFrame, keys: list[str], work, schema: str, then: list[str] | None = None, dealt: bool = False, rows: int = 0) -> DataFrame:
    """Apply ``work`` to runs of whole groups, many small groups at a call.

    Rows are dealt by the keys and sorted by them and ``then`` (or were so before, if
    ``dealt``); ``work`` gets at least ``rows`` rows whose groups are complete, and the
    starts of the groups. The last group waits for the next batch, so no more than that, a
    batch and one group is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if t.num_rows <= rows:
                held = t
                continue
            starts = group_starts(t)
            if len(starts) > 1:
                yield work(t.slice(0, int(starts[-1])).combine_chunks(), starts[:-1])
            held = t.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield work(held.combine_chunks(), group_starts(held))

    def group_starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t[k].to_numpy()
            new |= x[1:] != x[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1))

    if not dealt:
        df = df.repartition(*keys).sortWithinPartitions(*keys, *(then or []))
    return df.mapInArrow(task(run), schema)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate([np.zeros(0, np.int64), *a])
    y = np.concatenate([np.zeros(0, np.int64), *b])
    both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _forests(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Spanning forest of each block by Prim's method, most similar signatures first."""
    all_v, all_sig = t["v"].to_numpy(), _signatures(t["sig"])
    ends = np.append(starts[1:], t.num_rows)
    two = starts[ends - starts == 2]
    like = (all_sig[two] == all_sig[two + 1]).mean(axis=1) if len(two) else np.zeros(0)
    a, b = [all_v[two[like >= AGREE]]], [all_v[two[like >= AGREE] + 1]]
    for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        v, sig = all_v[s:e], all_sig[s:e]
        n = len(v)
        best, near, out = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, bool)
        cur = 0
        for _ in range(n - 1):
            out[cur] = True
            like = (sig == sig[cur]).mean(axis=1)
            up = ~out & (like > best)
            best[up], near[up] = like[up], cur
            cur = int(np.argmax(np.where(out, -2.0, best)))
            if best[cur] >= AGREE:
                a.append(v[near[cur] : near[cur] + 1])
                b.append(v[cur : cur + 1])
    return _pairs(a, b)


def _across(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Links of each cell across components: pairs whose signatures agree enough are checked
    exactly, and a link found makes its components one for the rest of the cell."""
    v, c, side = t["v"].to_numpy(), t["c"].to_numpy().copy(), t["side"].to_numpy().astype(bool)
    sig = _signatures(t["sig"])
    sets = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    a, b = [], []
    for s, e in zip(starts, np.append(starts[1:], t.num_rows)):
        left, right = s + np.flatnonzero(side[s:e]), s + np.flatnonzero(~side[s:e])
        for i in left:
            j = right[c[right] != c[i]]
            # no pair whose sizes differ more than LEAST allows can be a link
            j = j[np.minimum(sizes[j], sizes[i]) >= LEAST * np.maximum(sizes[j], sizes[i]) - 1e-9]
            like = (sig[j] == sig[i]).mean(axis=1)
            j = j[np.argsort(-like, kind="stable")[: int((like >= AGREE).sum())]]
            for k in range(0, len(j), 64):
                some = j[k : k + 64]
                some = some[c[some] != c[i]]
                if not len(some) or not sizes[i]:
                    continue
                at = np.cumsum(sizes[some]) - sizes[some]
                both = np.add.reduceat(np.isin(np.concatenate([sets[x] for x in some]), sets[i]), at, dtype=np.int64)
                for x in some[both * 1000 >= round(LEAST * 1000) * (sizes[some] + sizes[i] - both)]:
                    if c[x] != c[i]:
                        a.append(v[i : i + 1])
                        b.append(v[x : x + 1])
                        cell = c[s:e]
                        cell[cell == c[x]] = c[i]
    return _pairs(a, b)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, c, k, sig, text) rows with the text's shingle set in its place."""
    for batch in batches:
        n = batch.num_rows
        h, who = shingle_sets(string_array(batch.column("text")))
        parts = np.split(h, np.searchsorted(who, np.arange(1, n))) if n else []
        hashes = pa.array([x.tobytes() for x in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("c"), batch.column("k"), batch.column("sig"), hashes], ["v", "c", "k", "sig", "hashes"])


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of (a, b) pairs those whose texts have shingle sets of similarity LEAST or more.

    ``texts``: (v, text). Only texts that some pair needs are moved.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    have = texts.join(needed, "v", "left_semi")
    both = pairs.join(have.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a").join(have.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sets = []
            for name in ("ta", "tb"):
                h, who = shingle_hashes(string_array(batch.column(name)))
                cut = np.searchsorted(who, np.arange(1, n)) if (np.diff(who) >= 0).all() else None
                sets.append(np.split(h, cut) if cut is not None else [h[who == i] for i in range(n)])
            good = np.zeros(n, bool)
            for i in range(n):
                x, y = np.unique(sets[0][i]), np.unique(sets[1][i])
                both_n = len(np.intersect1d(x, y, assume_unique=True))
                # exact in integers: both / union >= LEAST
                good[i] = both_n > 0 and both_n * 1000 >= round(LEAST * 1000) * (len(x) + len(y) - both_n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "ta", "tb").mapInArrow(task(check), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) of every document."""
    small_batches(docs.sparkSession, 400)
    signed = staged(signature_rows(docs), "signatures")
    nodes = signed.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = staged(nodes.withColumn("v", F.monotonically_increasing_id()), "nodes")

    keyed = nodes.select("v", F.explode("bands").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("center")).where("n > 1")
    members = staged(keyed.join(counts, "key"), "buckets")  # nodes alone in all bands are gone
    sigs = nodes.join(members.select("v").distinct(), "v", "left_semi").select("v", "sig")
    member_sigs = members.join(sigs, "v")

    # Round one: a forest of each block; the bucket's centre is in every block of it.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = (F.abs(F.hash("v")) % F.col("blocks")).cast("int")
    spread = member_sigs.withColumn("blocks", blocks).withColumn("block", F.when(F.col("v") == F.col("center"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    one = spread.select("key", F.explode("block").alias("block"), "v", "sig")
    one = map_groups(one, ["key", "block"], _forests, "a long, b long").distinct()
    one = staged(one, "forest")

    # one copy of a text is moved: that of the node's id; others fall to keys of their own and go
    texts = docs.select(F.unhex(F.md5(text_or_empty().cast("binary"))).alias("t"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), text_or_empty().alias("text"))
    involved = nodes.join(members.select("v").distinct(), "v", "left_semi").select("t", F.coalesce("doc_id", F.lit(-1)).alias("id"), "v")
    texts = staged(texts.join(involved, ["t", "id"]).groupBy("v").agg(F.first("text").alias("text")), "texts")
    links = staged(similar_pairs(one, texts), "links")
    labels = connected_components(links)

    # Round two: families (what band buckets connect) that still hold several components.
    label = F.coalesce("c", "v")
    family = connected_components(members.select(F.col("v").alias("a"), F.col("center").alias("b")))
    family = family.select("v", F.col("c").alias("k"))
    marked = sigs.join(labels, "v", "left").select("v", "sig", label.alias("c")).join(family, "v", "left").withColumn("k", F.coalesce("k", "v"))
    marked = staged(marked, "marked")
    parts = marked.groupBy("k", "c").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("k").agg(F.count("*").alias("parts"), F.sum("m").alias("n"), F.max(F.struct("m", "c")).alias("big")).where("parts > 1")
    mixed = mixed.select("k", "n", F.col("big.c").alias("big"))
    rows = marked.join(mixed.select("k"), "k", "left_semi").join(texts, "v").select("v", "c", "k", "sig", "text")
    rows = rows.mapInArrow(task(_hashed), "v long, c long, k long, sig binary, hashes binary").join(mixed, "k")
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", own)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda i, j, left: ["k", i.alias("i"), j.alias("j"), "v", "c", "sig", "hashes", F.lit(left).alias("side")]
    cells = rows.where("c <> big").select(*side(F.col("own"), every, True)).union(rows.select(*side(every, F.col("own"), False)))
    two = map_groups(cells, ["k", "i", "j"], _across, "a long, b long")
    more = staged(two, "links-across")
    if not more.isEmpty():
        labels = connected_components(labels.select(F.col("v").alias("a"), F.col("c").alias("b")).union(more))

    named = nodes.join(labels, "v", "left").select("t", label.alias("c"), "doc_id")
    least = named.groupBy("c").agg(F.min("doc_id").alias("class_id"))
    classes = named.join(least, "c").select("t", "class_id")
    return signed.select("doc_id", "t").join(classes, "t").select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id (of equal ones the first by
    digest of the text); every column as it was."""
    row = unused(docs, "__dedup_row")
    held = with_row_id(docs, row)
    # rows are told apart by their number, so repeated and null ids are fine
    numbered = held.select(F.col(row).alias("doc_id"), "text")
    classes = near_duplicates(numbered)
    order = held.select(row, F.col("doc_id").cast("long").alias("id"))
    best = classes.join(order, classes.doc_id == order[row]).groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("best"))
    keep = best.select(F.col(f"best.{row}").alias(row))
    return held.join(keep, row, "left_semi").select(*docs.columns)
