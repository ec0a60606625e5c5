"""Toxicity by weak supervision.

1. Lexicon voters are mined from labelled rows: lower-case words and word beginnings of 4
   to 7 letters that stand more often in toxic rows than chance explains. Pattern voters look
   at the form of a text; one more votes where no term does. The annotators' labels are a voter
   like the others.
2. A generative model (two classes; each voter fires with its own rate in each class) is
   fitted by EM. A label that the other voters contradict is overruled as far as the estimated
   accuracies say; the labels' own is taken from the lexicon voters that agree best with them.
   Correlations are estimated from the residual covariance of the votes given the posterior; a
   vote's evidence is divided by one plus its voter's correlations with those that fire in the
   same text, so that a word and its own beginning don't count as two witnesses.
3. A linear classifier (logistic, L2) on the lexicon and pattern features learns the posterior
   labels and scores every document.

Only labelled rows with crc32(doc_id as text) mod 3 other than 1 are learnt from, at most
``MAX_ROWS`` ids of them in order of a hash, one row an id: the bounded sample that the fit
needs. Terms are counted in Spark; the driver gets the terms of that sample that pass, and for
each row which of them it holds. Labels, language, source and id are not features.

Nulls and odd input: a null text counts as empty and is scored by the intercept; rows with a
null label or id are not learnt from; an id with several labels is toxic if one says so, and
one with several texts is learnt from the first in order; with no labelled row of either class
every score is the share of toxic rows (0 without rows); repeated rows are scored alike; a very
long text is scored whole; an empty table gives an empty result; other columns, whatever their
names, are ignored or, by ``without_toxic``, kept as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import coded, small_batches, staged, string_array, task, text_or_empty

MAX_ROWS = 30_000  # labelled ids learnt from, at most
MIN_ROWS = 3  # toxic rows that a term must stand in
STRONG = 20  # strongest terms, by whose precision that of the others is judged
MIN_PRECISION = 0.9  # of a term, over that of the strongest
BEGINNINGS = (4, 5, 6, 7)  # letters
THRESHOLD = 0.7
# Patterns of form: name, expression, matches per 100 words from which it votes.
PATTERNS: list[tuple[str, str, float]] = [
    ("shouting", r"\b\p{Lu}{4,}\b", 5.0),
    ("exclaiming", r"!!+", 2.0),
    ("masked", r"\pL[*@#$]+\pL", 1.0),
]


@dataclass
class Model:
    terms: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS)))
    bias: float = -30.0
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)


def keys_of(word: str) -> list[str]:
    """A word as a feature and its beginnings."""
    return [word, *(word[:k] + "~" for k in BEGINNINGS if len(word) > k)]


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For every word of a batch its text and its code; and the distinct words."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL]+")
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    codes, words = coded(parts.flatten())
    return owner, codes, words


def batch_patterns(texts: pa.Array, n_words: np.ndarray) -> np.ndarray:
    """Which patterns vote on which text."""
    out = np.zeros((len(texts), len(PATTERNS)), bool)
    for j, (_, pattern, rate) in enumerate(PATTERNS):
        n = pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        out[:, j] = 100.0 * n >= rate * np.maximum(n_words, 1)
    return out


def batch_features(texts: pa.Array, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a batch; features past the terms are patterns."""
    owner, codes, words = batch_words(texts)
    hits = [[terms[k] for k in keys_of(w) if k in terms] for w in words]
    sizes = np.fromiter(map(len, hits), np.int64, len(hits))
    at = np.flatnonzero(sizes[codes] > 0)
    flat = np.fromiter((i for h in hits for i in h), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes[at]]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    feature = flat[np.repeat(starts[codes[at]], n) + inner] if len(flat) else np.zeros(0, np.int64)
    rows = np.repeat(owner[at], n)
    form = batch_patterns(texts, np.bincount(owner, minlength=len(texts)))
    r, c = np.nonzero(form)
    width = len(terms) + len(PATTERNS)
    pairs = np.unique(np.concatenate((rows * width + feature, r * width + c + len(terms))))
    return pairs // width, pairs % width


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Sampled (text, toxic) rows, one an id; the sample of ids is small enough to broadcast."""
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic") != 0).alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(MAX_ROWS)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = texts.join(F.broadcast(marks), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def mine_terms(rows: DataFrame) -> list[str]:
    """Terms in order of how well they tell toxic rows, by document frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, codes, words = batch_words(string_array(batch.column(0)))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            pairs = np.unique(owner.astype(np.int64) * len(words) + codes)
            doc, code = pairs // len(words), pairs % len(words)
            yes: Counter = Counter()
            no: Counter = Counter()
            for d in range(len(toxic)):
                keys = {k for c in code[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")] if words[c] for k in keys_of(words[c])}
                (yes if toxic[d] else no).update(keys)
            every = list(yes.keys() | no.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([yes[k] for k in every], pa.int64()), pa.array([no[k] for k in every], pa.int64())], ["term", "yes", "no"])

    counts = rows.mapInArrow(task(count), "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counts = staged(counts.where(F.col("yes") >= MIN_ROWS), "toxic-terms")
    # Of so many terms some stand in toxic rows by chance; what is kept tells more than that.
    n, share = counts.count(), rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not n or not 0 < share < 1:
        return []
    p = F.col("yes") / (F.col("yes") + F.col("no"))
    gain = F.col("yes") * F.log(p / share) + F.when(p < 1, F.col("no") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    strong = counts.orderBy(gain.desc(), "term").limit(STRONG).agg(F.sum("yes") / F.sum(F.col("yes") + F.col("no"))).first()[0]
    # where labels err, so do they on the strongest terms
    best = counts.where((p >= MIN_PRECISION * strong) & (gain > math.log(n))).select("term", F.round(gain, 6).alias("gain"))
    # of the bounded sample, so it is a bounded list
    return [r.term for r in sorted(best.collect(), key=lambda r: (-r.gain, r.term))]


def sample_features(rows: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of every vote, and the labels, of at most MAX_ROWS rows."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r, c = batch_features(string_array(batch.column(0)), terms)
                lists = [x.tolist() for x in np.split(c, np.searchsorted(r, np.arange(1, batch.num_rows)))]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "f"])

    got = sorted(rows.mapInArrow(task(features), "toxic boolean, f array<int>").collect())  # reruns agree
    row = np.repeat(np.arange(len(got)), [len(g.f) for g in got])
    col = np.fromiter((x for g in got for x in g.f), np.int64, len(row))
    return row, col, np.array([g.toxic for g in got], bool)


def label_model(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, lexicon: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row, and the rates (width + 2, 2) of the voters.

    The last two voters are silence (no lexicon voter, the first ``lexicon`` ones, fires) and
    the label; all but the label abstain where they don't fire. Labels give the voters' first
    rates; class balance and rates are then estimated.
    """
    n = len(y)
    silent = np.bincount(row[col < lexicon], minlength=n) == 0
    rates = np.empty((width + 2, 2))
    error = label_error(row, col, y, lexicon)
    rates[width + 1] = error, 1 - error
    share = float(y.mean())
    post = y.astype(np.float64)
    scale = np.ones(len(row))
    for step in range(rounds):
        on = np.array([1 - post, post])
        total = on.sum(axis=1)
        for c in (0, 1):
            fired = np.bincount(col, weights=on[c][row], minlength=width)
            rates[:width, c] = (fired + 0.1) / (total[c] + 1.0)
            rates[width, c] = ((on[c] * silent).sum() + 0.5) / (total[c] + 1.0)
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        if step % 8 == 0:
            scale = 1.0 / (1.0 + redundancy(row, col, post, rates[:width]))
        fire = np.log(rates[:, 1] / rates[:, 0])
        logit = np.log(share / (1 - share)) + np.bincount(row, weights=scale * fire[col], minlength=n)
        logit += np.where(silent, fire[width], 0.0)
        new = 1 / (1 + np.exp(-np.clip(logit + np.where(y, 1, -1) * np.log((1 - error) / error), -30, 30)))
        share = min(max((float(new.sum()) + 1.0) / (n + 2.0), 1e-4), 0.5)
        moved = float(np.abs(new - post).max())
        post = new
        if moved < 1e-4 and step > 8:
            break
    return post, rates


def label_error(row: np.ndarray, col: np.ndarray, y: np.ndarray, lexicon: int) -> float:
    """How often labels err, taken as the same for both classes: the share of labels against it
    of the median lexicon voter (by votes). A voter's own false votes are in its share too, so
    the better half of the voters is what tells."""
    fires = np.bincount(col[col < lexicon], minlength=lexicon)[:lexicon].astype(float)
    if not fires.sum():
        return 0.05
    against = np.bincount(col[col < lexicon], weights=~y[row[col < lexicon]], minlength=lexicon)[:lexicon] / np.maximum(fires, 1)
    order = np.argsort(against, kind="stable")
    at = int(np.searchsorted(np.cumsum(fires[order]), fires.sum() / 2))
    return float(np.clip(against[order[at]], 0.005, 0.45))


def redundancy(row: np.ndarray, col: np.ndarray, post: np.ndarray, rates: np.ndarray, least: float = 0.2) -> np.ndarray:
    """Of every vote, the sum of its voter's correlations with the others that fire in its row.

    Correlations are of the votes' residuals given the class, where they are clear. Votes must
    be distinct and in order of row.
    """
    width, n = len(rates), len(post)
    p1 = post.mean()
    var = n * (p1 * rates[:, 1] * (1 - rates[:, 1]) + (1 - p1) * rates[:, 0] * (1 - rates[:, 0]))
    out = np.zeros(len(row))
    for a, both in votes_together(row, col, width):
        some = slice(a, a + len(both))
        by_chance = n * (p1 * np.outer(rates[some, 1], rates[:, 1]) + (1 - p1) * np.outer(rates[some, 0], rates[:, 0]))
        rho = (both - by_chance) / np.sqrt(np.outer(var[some], var))
        rho[np.arange(len(rho)), np.arange(a, a + len(rho))] = 0.0
        rho = np.where(rho >= least, np.minimum(rho, 1.0), 0.0).T.astype(np.float32)
        in_row = np.zeros((n, rho.shape[1]), np.float32)
        for k in range(0, len(row), 50_000):
            r = row[k : k + 50_000]
            at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            in_row[r[at]] += np.add.reduceat(rho[col[k : k + 50_000]], at, axis=0)
        mine = np.flatnonzero((col >= a) & (col < a + len(both)))
        out[mine] = in_row[row[mine], col[mine] - a]
    return out


def votes_together(row: np.ndarray, col: np.ndarray, width: int, block: int = 128) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (first voter, (voters, width) counts) of the rows where two voters fire: all pairs
    of every row, with no more held than a block of voters."""
    code = np.unique(row.astype(np.int64) * max(width, 1) + col)
    row, col = code // max(width, 1), code % max(width, 1)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    n = int(row.max()) + 1 if len(row) else 0
    for a in range(0, width, block):
        mine = slice(*np.searchsorted(col, [a, a + block]))
        fired = np.zeros((n, min(block, width - a)), np.float32)
        fired[row[mine], col[mine] - a] = 1.0
        both = np.zeros((width, fired.shape[1]), np.float32)
        for k in range(0, len(row), 50_000):
            c = col[k : k + 50_000]
            at = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            both[c[at]] += np.add.reduceat(fired[row[k : k + 50_000]], at, axis=0)
        yield a, both.T


def linear_classifier(row: np.ndarray, col: np.ndarray, post: np.ndarray, width: int, l2: float = 0.5, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton steps with conjugate gradients.

    The rows of the rarer class weigh as much as the others together.
    """
    n = len(post)
    share = min(max(post.mean(), 1e-4), 1 - 1e-4)
    weight = post * (0.5 / share) + (1 - post) * (0.5 / (1 - share))
    times = lambda w, b: np.bincount(row, weights=w[col], minlength=n) + b
    back = lambda r: (np.bincount(col, weights=r[row], minlength=width), r.sum())
    loss = lambda w, b, z: (weight * (np.logaddexp(0, z) - post * z)).sum() + l2 / 2 * (w @ w)
    w, b = np.zeros(width), 0.0
    z = times(w, b)
    now = loss(w, b, z)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gw, gb = back(weight * (p - post))
        gw += l2 * w
        if max(np.abs(gw).max(initial=0), abs(gb)) < 1e-6 * n:
            break
        h = weight * p * (1 - p) + 1e-9
        dw, db, rw, rb = np.zeros(width), 0.0, -gw, -gb
        qw, qb, rr = rw.copy(), rb, rw @ rw + rb * rb
        for _ in range(60):
            hw, hb = back(h * times(qw, qb))
            hw += l2 * qw
            a = rr / (qw @ hw + qb * hb)
            dw, db, rw, rb = dw + a * qw, db + a * qb, rw - a * hw, rb - a * hb
            new = rw @ rw + rb * rb
            if new < 1e-8 * (gw @ gw + gb * gb):
                break
            qw, qb, rr = rw + new / rr * qw, rb + new / rr * qb, new
        step = 1.0
        while step > 1e-4:
            z2 = times(w + step * dw, b + step * db)
            if (then := loss(w + step * dw, b + step * db, z2)) < now:
                break
            step /= 2
        else:
            break
        w, b, z, now = w + step * dw, b + step * db, z2, then
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession, 1000, 6)
    rows = staged(training_rows(docs, labels), "toxic-sample")
    terms = {t: i for i, t in enumerate(mine_terms(rows))}
    row, col, y = sample_features(rows, terms)
    width = len(terms) + len(PATTERNS)
    if not len(y) or y.all() or not y.any():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, np.zeros(len(PATTERNS)), 30.0 if share == 1 else -30.0)
    post, rates = label_model(row, col, y, width, len(terms))
    w, b = linear_classifier(row, col, post, width)
    names = [*terms, *(p[0] for p in PATTERNS)]
    return Model(terms, w, b, {k: (float(rates[i, 1]), float(rates[i, 0])) for i, k in enumerate(names)})


def batch_scores(texts: pa.Array, model: Model) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    r, c = batch_features(texts, model.terms)
    logit = np.bincount(r, weights=model.weights[c], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    small_batches(docs.sparkSession, 1000, 6)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch_scores(string_array(batch.column(2)), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(task(score), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents predicted toxic; every column as it was."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(string_array(batch.column(at)), model) < threshold))

    return docs.mapInArrow(task(keep), docs.schema)
