"""Filter audit, run detection and substring removal against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tallyfield.llm import filter_audit, relative_parse
from tallyfield.llm.filter_audit import distinct_words, measure
from tallyfield.llm.relative_parse import remove_repeated_words
from tallyfield.llm.periodic_runs import Positions, dense_stretches, periodic_runs, runs_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORDS.findall(text or "")


def audited(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rank = lambda i: (i is not None, i)
    rows = []
    for i, text, source in docs:
        t, w = text or "", words_of(text)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": any((u or "") == t and rank(j) < rank(i) for j, u, _ in docs),
        }
        rows.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                fails = sum(f in r[1] for r in mine)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for i in range(150):
        w = [rng.choice(["alpha", "Beta", "GAMMA", "é", "日本", "x#", "tail\x1c"]) + str(rng.randrange(rng.choice([3, 500]))) for _ in range(rng.randrange(90))]
        docs.append((i, " ".join(w), rng.choice(["a", "b", None, ""])))
    docs += [(rng.randrange(300), rng.choice(docs)[1], rng.choice("ab")) for _ in range(100)] + [(7, docs[7][1], "a"), (None, docs[3][1], "b"), (None, docs[3][1], "a"), (500, None, "b"), (501, "", "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.randrange(2)) for i in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    got = filter_audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert audit_rows(got) == audited(docs, labels)


def test_filter_audit_of_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert audit_rows(filter_audit.filter_audit(odd.withColumn("part", odd.doc_id).withColumn("mask", odd.doc_id), labels)) == audited(rows, [tuple(r) for r in labels.collect()])
    assert filter_audit.filter_audit(empty, labels).count() == 0
    assert filter_audit.filter_audit(odd, labels.limit(0)).count() == 600 * len({r[2] or "" for r in rows})


def test_measures_of_texts_and_of_equal_hashes():
    rng = random.Random(8)
    texts = ["", " ", "A b c  d", "x" * 70 + " " + "x" * 69 + "y", "\n\tend\x0b"] + [
        "".join(rng.choice("ab é\n日#Q") for _ in range(rng.randrange(200))) for _ in range(200)
    ]
    m = measure(pa.array(texts, pa.large_string()))
    assert m["words"].tolist() == [len(words_of(t)) for t in texts]
    assert m["distinct"].tolist() == [len(set(words_of(t))) for t in texts]
    assert m["points"].tolist() == [len(t) for t in texts]
    assert m["capitals"].tolist() == [sum("A" <= c <= "Z" for c in t) for t in texts]
    assert m["symbols"].tolist() == [sum(c in "#$%&*|" for c in t) for t in texts]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    start, stop = filter_audit.word_bounds(filter_audit.CLASS[data], bounds)
    clash = (stop - start).astype(np.uint64) << np.uint64(60)  # words of equal length share a hash
    assert distinct_words(data, bounds, start, stop, clash)[1].tolist() == [len(set(words_of(t))) for t in texts]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(w):
    """(start, length, smallest period) by trying every period at every place."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in out.items())


def run_row(doc_id, text, remake=True):
    w = words_of(text)
    if remake and doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-(1000 * r[1] // r[2]), r), default=None)
    for r in runs:
        if r[1] * best[2] > best[1] * r[2] or (r[1] * best[2] == best[1] * r[2] and (r[0], r[2]) < (best[0], best[2])):
            best = r
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept), kept)


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(50))]
        if w and rng.random() < 0.5:
            p = rng.randrange(1, 9)
            w += [w[-1 - (p - 1 - i % p) % len(w)] for i in range(rng.randrange(60))]
            w += [rng.randrange(3) for _ in range(rng.randrange(9))]
        want = brute_runs(w)
        assert sorted((i, j - i, q) for (i, j), q in runs_of(w).items()) == want
        starts, ends = dense_stretches(np.array(w, np.int64), np.array([0, len(w)]))
        parts = [(a + i, j - i, q) for a, b in zip(starts.tolist(), ends.tolist()) for (i, j), q in runs_of(w[a:b]).items()]
        assert sorted(parts) == want


def test_positions_keep_order_over_many_blocks():
    rng = random.Random(2)
    for places in (rng.sample(range(10**6), 5000), list(range(3000, 0, -1)), list(range(3000))):
        s, have = Positions(places[0]), {places[0]}
        for x in places[1:]:
            before, after = s.add(x)
            if len(have) < 400 or x % 50 == 0:
                assert before == max((y for y in have if y < x), default=None)
                assert after == min((y for y in have if y > x), default=None)
            have.add(x)
        assert list(s) == sorted(places) and s.size == len(places)


def test_periodic_runs_query_on_the_small_tables(spark, sf):
    from tallyfield.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(words_of(r.text)) < 700]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    assert [got[r.doc_id] for r in short] == [run_row(*r)[:-1] for r in short]
    assert sum(r[1] for r in got.values()) > 0


def test_periodic_runs_of_odd_very_long_and_empty_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 7]
    got = [tuple(r) for r in periodic_runs(odd.withColumn("period", odd.doc_id), remake=True).collect() if r.doc_id != 7]
    assert by_repr(got) == by_repr(run_row(*r) for r in rows)
    assert periodic_runs(empty).count() == 0
    long = ["x " * 150_000, " ".join(str(i % 70_000) for i in range(300_000)) + " tail", " ".join(map(str, range(200_000)))]
    got = periodic_runs(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in got] == [(1, 0, 150_000, 1, 150_000_000), (1, 0, 300_000, 70_000, 4285), (0, None, None, None, None)]
    assert got[1].collapsed == " ".join(map(str, range(70_000))) + " tail"


def without_repeats(docs):
    """(doc_id, n_words, n_removed, sha, kept) by asking every window of every document."""
    rank = lambda i: (i is not None, i or 0)
    first = {}
    for i, text in docs:
        w = words_of(text)
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, rank(i)), rank(i))
    out = []
    for i, text in docs:
        w = words_of(text)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < rank(i) for j in range(50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), sha(kept), kept))
    return out


def shared_corpus(rng):
    """Documents of passages that others hold too: whole, cut, joined, changed in a word."""
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    hot, long = fresh(63), fresh(400)
    pool = [fresh(rng.randrange(45, 140)) for _ in range(12)] + [hot, long, ["a"] * 90, ["a", "b"] * 70]
    docs = []
    for _ in range(260):
        w = fresh(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(pool))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            if rng.random() < 0.3:
                p = p[rng.randrange(20) :]
            w += p + (fresh(rng.randrange(1, 40)) if rng.random() < 0.6 else [])
        docs.append(" ".join(w + (hot if rng.random() < 0.5 else [])))
    return docs + docs[:20] + [" ".join(long * 3), None, "", "  "]


@pytest.mark.parametrize("hot, mb, together", [(2000, 8, 15_000), (3, 0.01, 5), (40, 0.002, 100)])
def test_repeated_words_equal_brute_force(spark, monkeypatch, hot, mb, together):
    for name, value in (("HOT", hot), ("SLICE_MB", mb), ("TOGETHER", together)):
        monkeypatch.setattr(relative_parse, name, value)
    rng = random.Random(9)
    texts = shared_corpus(rng)
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = remove_repeated_words(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    want = without_repeats(docs)
    assert sum(r[2] for r in want) > 10_000
    assert by_repr(got) == by_repr(want)


def test_repeated_words_of_odd_repeated_and_empty_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    passage = " ".join(f"p{i}" for i in range(60))
    more = [(i, f"{x} {passage} {x}") for x, i in zip("abcdefg", (9, 9, 11, None, None, 12, 9))]
    extra = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = remove_repeated_words(extra.withColumns({"doc": extra.doc_id, "row": extra.doc_id, "spans": extra.doc_id})).collect()
    assert by_repr(got) == by_repr(without_repeats(rows + more))
    assert remove_repeated_words(empty).count() == 0


def test_very_long_documents_of_one_word_and_of_copies(spark):
    long = [f"v{i}" for i in range(120_000)]
    docs = [(0, "x " * 60_000), (1, " ".join(long)), (2, "y " + " ".join(long[3:]) + " z"), (3, "x " * 59)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeated_words(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: (60_000, 0), 1: (120_000, 0), 2: (119_999, 119_997), 3: (59, 59)}


def test_parsing_with_windows_of_one_hash():
    rng = random.Random(4)
    texts = [[rng.randrange(3) for _ in range(40)] + list(range(100, 170)) + [rng.randrange(3) for _ in range(rng.randrange(60))] for _ in range(12)]
    codes, bounds = np.array(sum(texts, [])), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    starts = relative_parse.window_starts(bounds)
    for hashes in (np.zeros(len(starts), np.uint64), (codes[starts] % 5).astype(np.uint64)):
        a, b = relative_parse.parse(codes, starts, hashes, bounds, np.arange(12))
        gone = {i for x, y in zip(a.tolist(), b.tolist()) for i in range(x, y)}
        want = set()
        for t, w in enumerate(texts):
            earlier = {tuple(u[k : k + 50]) for u in texts[:t] for k in range(len(u) - 49)}
            want |= {int(bounds[t]) + k + j for k in range(len(w) - 49) if tuple(w[k : k + 50]) in earlier for j in range(50)}
        assert gone == want
