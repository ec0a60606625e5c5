"""Mixing, quality rules and WARC."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm.mixing import document_sizes, mix_documents, mix_plan, mixed
from tallyfield.llm.quality_rules import ablations, ledger, quality_rules
from tallyfield.llm.warc import PLAIN_MARK, archive_round_trip, gzip_member, read_archives, reachable, record_bytes, write_archives

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes: dict, share=1.5, cap=2.0) -> dict:
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mix_of_odd_rows(spark, odd, empty):
    rows = mix_plan(odd).collect()
    assert len(rows) == odd.count() and mix_plan(empty).collect() == []
    sizes = defaultdict(int)
    for r in odd.collect():
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    want = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    assert sorted(rows, key=str) == sorted(mix_plan(odd).collect(), key=str)
    assert sum(r.copies for r in rows) == mix_documents(odd).count()
    assert mix_documents(odd).columns == odd.columns


def test_mix_comes_near_targets(spark):
    rng = np.random.default_rng(1)
    d = [(i, f"s{int(rng.integers(0, 7)) if i % 3 else 0}", int(rng.lognormal(4, 1.2))) for i in range(6000)]
    rows = mixed(spark.createDataFrame(d, "doc_id long, source string, size long")).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        b = by[r.source]
        b[0], b[1], b[2] = b[0] + r.taken, r.target, max(b[2], r.size)
    assert all(abs(t - want) <= most for t, want, most in by.values())
    assert sum(b[1] for b in by.values()) == pytest.approx(1.5 * sum(r[2] for r in d))


def test_ties_are_cut_by_salt(spark):
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"))
    copies = Counter(r.copies for r in mixed(d).collect())
    assert set(copies) == {1, 2} and abs(copies[2] - 2500) <= 1


def brute(text: str):
    w = WORDS.findall(text)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(win)
    hit = set()
    for i, x in enumerate(win):
        if c[x] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(hit)


def test_ledger_equals_brute_force(spark, odd, empty):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(200)]
    texts += ["\n".join(rng.choice(["l1 x", "l2 % y", " ", "l3"], 12)) for _ in range(50)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules(d).collect():
        n, chars, sym, dup, rep = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.kept and r.base_failed)
    assert quality_rules(odd).count() == odd.count() and quality_rules(empty).collect() == []
    long = quality_rules(odd).where("doc_id = 7").first()
    assert (long.n_words, long.n_repeat_words) == (3000, 3000)


def test_ablations_follow_from_bits(spark, odd, empty):
    led = ledger(odd)
    rows = led.collect()
    for r in ablations(led, policies={"p": 0b111}).collect():
        bit = {"too_few_words": 1, "repeated_words": 2, "symbols": 4}[r.rule]
        assert r.n_docs == len(rows) and r.n_failing == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_only == sum(x.fail_bits & 0b111 == bit for x in rows) and r.n_rejected == sum(bool(x.fail_bits & 0b111) for x in rows)
    assert ablations(ledger(empty)).collect() == []


PAGES = [(1, "u", "<p>same</p>"), (9, "v", "<p>same</p>"), (4, None, "<p>same</p>"), (2, "a b\r\nc", None), (3, "w", ""), (5, "x", "é" * 50_000), (6, "y", "alone"), (6, "y", "alone"), (None, "z", "<p>same</p>"), (None, "z", "no id"), (7, "q", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n12345\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in archive_round_trip(pages, compress=compress).collect()), key=str)
    top = {}
    for i, _, h in PAGES:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = top.get(h or "")
        revisit = first is not None and i != first
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_warc_of_nothing(spark):
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_magic_inside_payloads_is_rejected(spark, tmp_path):
    inner = record_bytes(99, "u", b"fake", None)
    plain = record_bytes(1, "u", b"x" + inner + inner, None) + record_bytes(2, "u", b"tail", None)
    member = gzip_member(inner)
    stored = gzip_member(record_bytes(1, "u", b"x" + member, None), level=0) + gzip_member(record_bytes(2, "u", b"tail", None))
    for name, data in (("a.warc", plain), ("b.warc.gz", stored)):
        (tmp_path / name).write_bytes(data)
        rows = read_archives(spark, [{"file": f"file://{tmp_path}/{name}", "bytes": len(data)}], with_payload=True, split_bytes=64).collect()
        assert sorted(r.page_id for r in rows) == [1, 2]
    assert plain.count(PLAIN_MARK) == 4
    cut = plain[:-10]
    (tmp_path / "c.warc").write_bytes(cut)
    with pytest.raises(Exception, match="chain of records breaks"):
        read_archives(spark, [{"file": f"file://{tmp_path}/c.warc", "bytes": len(cut)}]).collect()


def test_pointer_jumping():
    starts, nexts = np.array([0, 10, 15, 30, 31]), np.array([10, 30, 99, 40, 40])
    assert reachable(starts, nexts, 40).tolist() == [True, True, False, True, False]
    with pytest.raises(ValueError):
        reachable(starts[1:], nexts[1:], 40)


def test_large_archives_are_split(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat(cast(id as string), 500)").alias("html"))
    files = write_archives(pages, f"file://{tmp_path}", file_bytes=5000)
    assert len(files) > 10 and read_archives(spark, files, split_bytes=1000).count() == 300


def test_sizes_count_words(odd):
    for r in document_sizes(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.size == len(WORDS.findall(r.text or ""))


def test_plain_records_with_headers_longer_than_what_is_read_ahead(spark, tmp_path):
    from tallyfield.llm import warc

    long = "http://a.example/" + "q" * 70_000
    rows = [(i, (long if i % 2 else "http://b.example/") + str(i), f"<p>{i}</p>" + "WARC/1.1\r\n" * (i == 3)) for i in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for compress in (False, True):
        (tmp_path / str(compress)).mkdir()
        files = warc.write_archives(pages, f"file://{tmp_path}/{compress}", compress=compress)
        for split in (1000, 80_000, 1 << 20):
            got = warc.read_archives(spark, files, with_payload=True, split_bytes=split).orderBy("page_id").collect()
            assert [(r.page_id, r.url, r.payload.decode()) for r in got] == rows
