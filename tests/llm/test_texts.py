"""Near-duplicates, repeats, toxicity, decontamination, HTML."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import decontaminate, near_dedup, repeats, toxicity
from tallyfield.llm.components import connected_components
from tallyfield.llm.decontaminate import Items, contaminated, edit_distance_to_prefix, without_benchmark
from tallyfield.llm.html_text import main_text
from tallyfield.llm.near_dedup import dart_signatures, near_duplicates, one_of_each, shingle_hashes
from tallyfield.llm.repeats import remove_repeats
from tallyfield.llm.suffix_groups import suffix_arrays


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows):
    """Least id of the components of equal texts and of shingle sets 0.8 alike."""
    par = list(range(len(rows)))

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    s = [shingles(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or s[i] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                par[top(i)] = top(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[top(i)].append(rows[i][0])
    return [min((x for x in least[top(i)] if x is not None), default=None) for i in range(len(rows))]


def family(rng, n, words=80, edits=5):
    """Copies of one text with a few words changed, each from a random earlier copy."""
    out = [[f"w{rng.randrange(400)}" for _ in range(words)]]
    for _ in range(n - 1):
        c = list(rng.choice(out[-40:]))
        for _ in range(rng.randrange(edits)):
            c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
        out.append(c)
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("block", [16, 512])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(5)
    texts = family(rng, 120) + family(rng, 60, 30, 3) + family(rng, 30, 200, 40)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(20)) for _ in range(60)] + texts[:25] + ["a b", "a  b", "a b c", "", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = classes(rows)
    wrong = [i for i in range(len(rows)) if got[i] != want[i]]
    assert not wrong


def test_near_duplicates_that_repeat_lines_differently(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        line = [f"l{rng.randrange(10**6)}" for _ in range(10)]
        for times in (1, 2, 8, 60):
            rows.append((len(rows), " ".join(words + line * times)))
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = classes(rows)
    assert len(set(want)) == 40
    assert [got[i] for i, _ in rows] == want


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = sorted(map(tuple, near_duplicates(odd).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got == sorted(zip([r[0] for r in rows], classes(rows)), key=str)
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len({(c, t if c is None else "") for (_, t), c in zip(rows, classes(rows))})
    assert near_duplicates(empty).collect() == [] and one_of_each(empty).collect() == []


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    other = base.copy()
    other[:45] = rng.integers(0, 2**63, 45).astype(np.uint64)
    h = np.concatenate((base, other, base[:3], np.repeat(base[:3], 5)))
    who = np.concatenate((np.zeros(400), np.ones(400), np.full(3, 2), np.full(15, 3))).astype(np.int64)
    s = dart_signatures(h, who, 4, 2000)
    assert abs((s[0] == s[1]).mean() - 355 / 445) < 0.04
    w = 1 + np.log(5)
    assert abs((s[2] == s[3]).mean() - 1 / w) < 0.05
    assert (dart_signatures(h[:0], who[:0], 2) == 0).all()


def test_short_texts_are_one_shingle():
    h, who = shingle_hashes(pa.array(["a b c", "", "a b c d e f", "a b"], pa.large_string()))
    assert sorted(who.tolist()) == [0, 2, 2, 3] and len(set(h.tolist())) == 4


def test_components(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 500)]
    par = {x: x for ab in e for x in ab}

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in e:
        par[max(top(a), top(b))] = min(top(a), top(b))
    got = dict(connected_components(spark.createDataFrame(e, "a long, b long")).collect())
    assert got == {x: top(x) for x in par if top(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(150):
        lens = rng.integers(0, 50, rng.integers(1, 9))
        x = rng.integers(0, rng.integers(1, 5), int(lens.sum()))
        want, at = [], 0
        for n in lens:
            s = x[at : at + n].tolist()
            want += [at + i for i in sorted(range(n), key=lambda i: s[i:])]
            at += n
        assert suffix_arrays(x, lens).tolist() == want


def cut(rows):
    """(id, text) in document order to what is left after brute-force removal."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chain", [4096, 300])
def test_repeats_equal_brute_force(spark, monkeypatch, chain):
    monkeypatch.setattr(repeats, "CHAIN", chain)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (90, 100, 101, 150, 400)]
    rows = []
    for i in range(150):
        parts = [text(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(passages)[rng.randrange(3) :], text(rng.randrange(30))]
        rows.append((i, "".join(parts)))
    rows += [(200, "ab" * 400), (201, "ab" * 150 + "c" + "ab" * 99), (202, rows[3][1]), (203, rows[3][1]), (204, "the " * 300)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == cut(rows)


def test_repeats_of_odd_rows(spark, odd, empty):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x))
    got = remove_repeats(odd)
    assert sorted(map(tuple, got.drop("kept").collect()), key=str) == cut(rows)
    assert remove_repeats(empty).collect() == []


def toxic_world(spark, n=1500, seed=0):
    rng = random.Random(seed)
    bad = ["grubling", "snarkfest", "vexoid", "drubber"] + [f"zorp{x}" for x in ("ia", "ul", "enn", "ock", "ade", "ist", "orm")]
    rows, labels = [], []
    for i in range(n):
        w = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randrange(20, 120))]
        w = ["".join(chr(97 + int(c)) for c in str(hash((x, 7)) % 10**7)) for x in w]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), toxic))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic != (rng.random() < 0.02))))
    return spark.createDataFrame(rows, "doc_id long, text string, truth boolean"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out_documents(spark):
    docs, labels = toxic_world(spark)
    model = toxicity.fit(docs, labels)
    r = toxicity.score_documents(docs, model).join(docs.select("doc_id", "truth"), "doc_id").collect()
    held = [x for x in r if x.held_out]
    assert len(held) > 300 and all((x.predicted == 1) == (x.score >= 0.7) for x in r)
    hits = [x.predicted for x in held if x.truth]
    clean = [x.predicted for x in held if not x.truth]
    assert np.mean(hits) > 0.95 and np.mean(clean) < 0.01
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    again = {x.doc_id: x.score for x in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-9 for x in r)


def test_correlated_voters_count_less():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    a = y & (rng.random(4000) < 0.6)
    votes = np.stack([a, a, y & (rng.random(4000) < 0.6)], 1)
    row, col = np.nonzero(votes)
    post, rates = toxicity.label_model(row, col, y, 3, 3)
    extra = toxicity.redundancy(row, col, post, rates[:3])
    assert (extra[col < 2] > 0.8).all() and (extra[col < 2] < 1.3).all() and (extra[col == 2] < 0.5).all()
    assert (rates[:3, 1] > 0.4).all() and (rates[:3, 0] < 0.05).all()


@pytest.mark.parametrize("noise", [0.0, 0.1])
def test_label_model_overrules_flipped_labels(noise):
    """With 10 % of labels flipped the posterior mends most, and a classifier on it finds as
    much of new rows as one fitted to the labels; labels that are right stay."""
    rng = np.random.default_rng(1)
    n, words = 9000, 24
    truth = rng.random(n) < 0.12
    fired = np.where(truth[:, None], rng.random((n, words)) < 0.14, rng.random((n, words)) < 0.0005)
    fired = np.concatenate((fired, fired[:, :6], rng.random((n, 2)) < 0.1), 1)  # beginnings, and patterns that tell nothing
    y = truth ^ (rng.random(n) < noise)
    train = np.arange(n) < 6000
    row, col = np.nonzero(fired[train])
    post, rates = toxicity.label_model(row, col, y[train], 32, 30)
    wrong = y[train] != truth[train]
    now_wrong = (post > 0.5) != truth[train]
    assert abs(rates[-1, 0] - max(noise, 0.005)) < 0.04
    assert now_wrong.sum() <= max(0.35 * wrong.sum(), 0.01 * train.sum())
    scores = lambda target: fired[~train] @ (wb := toxicity.linear_classifier(row, col, target, 32))[0] + wb[1]
    told = lambda target: (scores(target)[truth[~train]] > 0.847).mean()  # noqa: E731  score 0.7
    assert told(post) >= told(y[train].astype(float)) - 0.01 and (scores(post)[~truth[~train]] > 0.847).mean() < 0.02


def test_toxicity_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 0), (None, 1, 1), (2, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        r = toxicity.score_documents(odd, toxicity.fit(odd, labels)).collect()
        assert len(r) == odd.count() and all(0 <= x.score <= 1 and x.predicted == 0 for x in r)
    assert toxicity.without_toxic(odd, some).count() == odd.count()
    assert toxicity.score_documents(empty, toxicity.fit(empty, none)).collect() == []


def test_redundancy_counts_all_votes_of_a_row():
    rng = np.random.default_rng(6)
    fired = rng.random((400, 320)) < np.where(rng.random((400, 1)) < 0.3, 0.9, 0.02)
    fired[:, 319] = fired[:, 318]
    row, col = np.nonzero(fired)
    together = np.concatenate([b for _, b in toxicity.votes_together(row, col, 320)])
    assert (together == fired.T.astype(int) @ fired.astype(int)).all()
    rates = np.repeat(fired.mean(axis=0)[:, None], 2, axis=1).clip(1e-6, 1 - 1e-6)
    p = rates[:, 0]
    rho = (together / 400 - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    np.fill_diagonal(rho, 0)
    rho = np.where(rho >= 0.2, np.minimum(rho, 1), 0)
    want = np.array([rho[c, np.flatnonzero(fired[r])].sum() for r, c in zip(row, col)])
    assert np.allclose(toxicity.redundancy(row, col, np.full(400, 0.5), rates), want, atol=1e-4)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_edit_distance_to_a_beginning():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        want = min(levenshtein(a, b))
        k = rng.randrange(6)
        assert edit_distance_to_prefix(a, b, k)[0] == min(want, k + 1)


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(3)
    return [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(n))) for i, n in enumerate([3, 8, 15, 30, 30, 50])]


@pytest.mark.parametrize("width", [5, 9, 20, 40, 50, 59])
@pytest.mark.parametrize("kind", ["delete", "block", "insert", "replace", "mixed"])
def test_decontamination_at_the_full_bound(monkeypatch, kind, width):
    monkeypatch.setattr(decontaminate, "SPREAD", 500, raising=False)
    rng = random.Random(f"{kind}{width}")
    items = [[f"b{rng.randrange(400)}" for _ in range(width)] for _ in range(5)]
    texts, k = [], int(0.2 * width)
    for n in range(60):
        p = list(items[n % 5])
        block = rng.randrange(width - k + 1)
        for x in range(k):
            how = rng.choice(["delete", "insert", "replace"]) if kind == "mixed" else kind
            at = block if how == "block" else rng.randrange(len(p))
            p[at : at + 1] = {"insert": [f"x{x}", *p[at : at + 1]], "replace": [f"x{x}"]}.get(how, [])
        texts.append([f"b{rng.randrange(400)}" for _ in range(30)] + p + [f"t{rng.randrange(900)}" for _ in range(30)])
    got = {(t, i): x for t, i, *x in Items([(i, " ".join(w)) for i, w in enumerate(items)]).matches(pa.array([" ".join(t) for t in texts], pa.large_string()))}
    want = {}
    for t, w in enumerate(texts):
        for i, item in enumerate(items):
            # least edits to any stretch from each start: the last row of the full table
            d, a = min((min(levenshtein(item, w[a : a + width + k])), a) for a in range(len(w))) if t % 5 == i else (k + 1, 0)
            if d <= k:
                want[t, i] = d, a
    assert len(want) == 60 and {x: (d, a) for x, (a, _, d) in got.items()} == want
    assert all(levenshtein(items[i], texts[t][a : a + n])[-1] == d for (t, i), (a, n, d) in got.items())


def test_draws_reach_their_recall():
    """Of edited passages with 20 % of words changed, how many does one of the draws bring up?"""
    rng = np.random.default_rng(8)
    for width in (15, 30, 59, 90):
        found = n = 0
        for kind in ("delete", "insert", "replace"):
            for _ in range(40):
                item = rng.integers(0, 2**62, width).astype(np.uint64)
                p = item.tolist()
                for _ in range(int(decontaminate.EDITS * width)):
                    at = int(rng.integers(len(p)))
                    p[at : at + 1] = {"delete": [], "insert": [int(rng.integers(2**62)), p[at]], "replace": [int(rng.integers(2**62))]}[kind]
                h = np.concatenate((rng.integers(0, 2**62, 20), p, rng.integers(0, 2**62, 60))).astype(np.uint64)
                where = {x: i for i, x in enumerate(item.tolist())}
                starts = {i - where[x] for i, x in enumerate(h.tolist()) if x in where and where.get(h[i + 1]) == where[x] + 1}
                stretch = (0, 0, 0, len(h) - 1, np.array(sorted(max(x, 0) for x in starts)))
                found += len(decontaminate.sampled_alike(h, np.array([0, len(h)]), [stretch], {0: item}))
                n += 1
        assert found >= decontaminate.RECALL * n - 1, (width, found, n)


def test_large_benchmarks_go_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(20))) for i in range(30)]
    docs = spark.createDataFrame([(i, f"some words {t} and more") for i, t in items] + [(99, "clean words only in this one")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PART_BYTES", 1000)
    assert len(list(decontaminate.load_items(b))) > 1
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, b).collect()) == [(i, i) for i, _ in items]
    assert [r.doc_id for r in without_benchmark(docs, b).collect()] == [99]


def test_decontamination_finds_edited_passages(spark, bench):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(300):
        w = [f"b{rng.randrange(900)}" if rng.random() < 0.3 else f"t{rng.randrange(9000)}" for _ in range(150)]
        if i % 3 == 0:
            item, text = bench[rng.randrange(len(bench))]
            p = text.split()
            for _ in range(int(0.1 * len(p))):
                k = rng.randrange(len(p))
                p[k : k + 1] = rng.choice([[], ["edit"], [p[k], "more"]])
            at = rng.randrange(len(w))
            w[at:at] = p
            want[i] = item
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = contaminated(docs, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want.items())
    assert without_benchmark(docs, b).count() == 300 - len(want)


def test_decontamination_of_odd_rows(spark, odd, empty, bench):
    b = spark.createDataFrame([*bench, (9, None), (None, ""), (10, "word " * 6), (11, "word " * 6), (12, "x")], "item_id long, text string").withColumn("k", F.lit(1))
    got = sorted((r.doc_id, r.item_id) for r in contaminated(odd, b).collect())
    assert got == [(7, 10), (7, 11), (8, 12)]
    assert without_benchmark(odd, b).columns == odd.columns and without_benchmark(odd, b).count() == odd.count() - 2
    assert contaminated(empty, b).collect() == [] and contaminated(odd, b.where("false")).collect() == []


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


LONG = "A sentence of the article with enough words to look like prose, and then some more. " * 3
ARTICLE = f"<h1>Head &amp; line</h1><p>{LONG}<p><b>Second</b> part&nbsp;with <a href=x>a link</a>.<br>More {LONG}</p><ul><li>one<li>two</ul>"
WANT = ["Head & line", LONG.strip(), f"Second part with a link. More {LONG.strip()}", "one", "two"]


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{ARTICLE}</article>",
        f"<nav><ul><li><a href=/>Home</a></ul></nav><header><h2>Site</h2></header><article>{ARTICLE}</article><aside>Side {LONG}</aside><footer>&copy; x</footer>",
        f"<div class='ad'>Buy {LONG}</div><main><article>{ARTICLE}<div id=comments><p>First! {LONG}</div></article></main>",
        f"<form><article>{ARTICLE}<form><input><label>Mail</label></form></article></form>",
        f"<div class='cookie-notice'>We {LONG}</div><div><div class=content>{ARTICLE}</div><div class=menu><a>x</a><a>y</a></div></div><script>var a='</p><p>no';</script>",
        f"<article>{ARTICLE}</article><section class='reader-comments'><article><p>Me too {LONG}</p></article></section>",
    ],
)
def test_main_text(body):
    assert main_text(page(body)).split("\n\n") == WANT


SHORT = "Short one."


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div class='layout has-sidebar'><div class=content><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></div><footer>x</footer>", "TLL"),
        (f"<div>Site</div><form id='aspnetForm'><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><input></form><footer>x</footer>", "TLL"),
        (f"<form id='aspnetForm'><div><p>{LONG}</p><p>{LONG}</p></div><input></form>", "LL"),
        (f"<article><h1>T</h1><p>{LONG}</p><div class='social-history'><p>{LONG}</p></div><section id='search-methods'><p>{SHORT}</p></section></article>", "TLLS"),
        (f"<article><header><h1>T</h1></header><div class='body'><p>{LONG}</p><p>{SHORT}</p></div></article><div class='related-posts'><p>{LONG}</p></div>", "TLS"),
        (f"<main><h1>T</h1><section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><p>{SHORT}</p></section></main>", "TLLLS"),
        (f"<article><p>{LONG}</p></article><article><p>{LONG}</p><p>{SHORT}</p></article>", "LLS"),
        (f"<div class='comments'><p>{LONG * 4}</p></div><article><h1>T</h1><p>{LONG}</p></article>", "TL"),
    ],
)
def test_frames_and_class_words(body, want):
    names = {"T": "T", LONG.strip(): "L", SHORT: "S"}
    assert "".join(names.get(b, "?") for b in main_text(page(body)).split("\n\n")) == want


def test_threshold_marks_what_the_definition_says(sf):
    """Densities, sums and marks of real pages against a plain recursion over the tree."""
    import math

    import pyarrow.parquet as pq

    from tallyfield.llm import html_text

    by_threshold = 0
    for html in pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist()[:120]:
        root = html_text.parse(html)
        order = html_text.measure(root)
        marked = html_text.marked_nodes(root, order)

        def counts(n):
            c, t, lc, lt = sum(len(" ".join(x.split())) for x in n.items if isinstance(x, str)), 0, 0, 0
            for k in html_text.kept_children(n):
                kc, kt, klc, klt = counts(k)
                c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt + (k.tag == "a")
            return c, t, c if n.tag == "a" else lc, lt

        body = counts(root)

        def density(n):
            c, t, lc, lt = counts(n)
            if not c:
                return 0.0
            base = math.log(c * lc / max(c - lc, 1) + body[2] * c / max(body[0], 1) + math.e)
            return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / base

        def total(n):
            return sum(density(k) if k.tag in html_text.BLOCK else total(k) for k in html_text.kept_children(n))

        totals = {id(n): total(n) for n in order}
        assert all(math.isclose(n.density, density(n), rel_tol=1e-9) and math.isclose(n.total, totals[id(n)], rel_tol=1e-9) for n in order)
        best = max(order, key=lambda n: totals[id(n)])
        threshold = min(density(n) for n in html_text.path_of(best)) if totals[id(best)] else 0
        below = lambda n: [n, *(x for k in html_text.kept_children(n) for x in below(k))]
        if totals[id(best)]:
            want = {id(max(below(n), key=lambda x: totals[id(x)])) for n in order if n.chars and density(n) >= threshold}
            outer = [n for n in order if id(n) in want and not any(id(a) in want for a in html_text.path_of(n)[:-1])]
            assert {id(n) for n in outer} == {id(n) for n in marked}
            by_threshold += 1
    assert by_threshold == 50  # every page of this table


def test_pages_without_text(spark):
    from tallyfield.llm.html_text import extract_pages

    for p in ("", "<html></html>", "<nav>menu</nav>", "<script>x</script>", "<!-- -->", "<p", "<div class='"):
        assert main_text(p) in ("", "<p", "<div class='")
    rows = [(1, "u", None), (None, "v", page(f"<article>{ARTICLE}</article>")), (2, None, "<p>plain"), (2, None, "<p>plain"), (3, "w", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = extract_pages(d).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, len("\n\n".join(WANT))), (1, 0), (2, 5), (2, 5), (3, 4)]
    assert all(r.n_chars == len(r.text) for r in got) and extract_pages(d.where("false")).collect() == []


def ordinary(about, n=3):
    return "".join(f"<p>Ordinary sentence number {i} about {about}, long enough to be a paragraph of an article and not a label.</p>" for i in range(n))


def test_a_form_round_an_article_and_a_line_outside():
    t = main_text(f'<body><form id="aspnetForm"><div>{ordinary("forms")}</div></form><div class="bottom">Copyright 2020 Somebody</div></body>')
    assert t.count("about forms") == 3
    t = main_text(f'<body><div>{ordinary("text", 4)}</div><form><p>Leave your address here and we will write to you about nothing at all.</p><input></form></body>')
    assert t.count("about text") == 4 and "address" not in t


@pytest.mark.parametrize("tag", ['<section class="share">', '<section id="methods-search">', '<div class="section-social">', '<div class="menu">'])
def test_parts_named_like_furniture(tag):
    end = tag[1:].split()[0]
    around = lambda inner: f"<body><article><h1>T</h1>{ordinary('one', 4)}{tag}{inner}</{end}>{ordinary('two', 2)}</article></body>"
    t = main_text(around(ordinary("inner", 1)))
    assert "about inner" in t and t.count("about one") == 4 and t.count("about two") == 2
    t = main_text(around('<a href="/a">Share it on A</a> <a href="/b">Share it on B</a> or <b>copy</b>'))
    assert "Share it" not in t and "copy" not in t and t.count("about two") == 2


def test_articles_side_by_side_are_all_taken():
    cards = "".join(f'<article><a href="/{i}">Another story that one could read next, number {i} of many</a></article>' for i in range(4))
    t = main_text(f"<body><article><h2>A</h2>{ordinary('first', 5)}</article><article><h2>B</h2>{ordinary('second', 1)}</article>{cards}</body>")
    assert t.count("about first") == 5 and t.count("about second") == 1 and "Another story" not in t
    assert t.index("about first") < t.index("about second")
