"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Writing. Pages are grouped by payload digest; the page with the largest id of a group is
its response and the others are revisits that refer to it (``least_bytes`` sets the size
below which all are responses). Groups are reduced to one row before they meet the pages,
and the join can be split by Spark where one payload fills a large part of the table. Tasks
write files of about ``FILE_BYTES``, one gzip member a record (or none), under a name of the
attempt, and rename them when complete.

Reading. Tasks take byte ranges of the files and report every offset that looks like a
record's start, with the offset at which its record would end: the length field of the gzip
header, or the Content-Length of a plain header. The look of a start can occur inside a
payload, so per file pointer jumping from offset 0 marks what is reachable in a chain of
records; all other candidates are dropped. The chain must end at the end of the file. Reached
records are dealt by byte range again and parsed, and payload digests are computed again.

Nulls and odd input: a null html counts as empty; equal ids with equal payloads are all
responses, as they are the largest of their group; a page without an id refers to the
largest id of its group, if one has any; an empty table gives no file and no rows; a very
long page is one record, held by its task alone; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import fresh_dir, open_fs, small_batches, task, text_or_empty

FILE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
AHEAD_BYTES = 64 << 10  # read behind a split; longer headers are read on until they end
PLAIN_MARK = b"WARC/1."
GZIP_MARK = b"\x1f\x8b\x08\x04"
GZIP_EXTRA = struct.Struct("<HccHQ")  # XLEN, the two letters of the subfield, its size, member length
PREFIX = "urn:page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with the type of their record and, for revisits, the response's page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    p = p.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = p.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    p = p.join(groups.where("n > 1").drop("n"), "sha1", "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return p.select("page_id", "url", "html", F.when(revisit, F.col("top")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    clean = re.sub(r"[\x00-\x20\x7f]+", "%20", url or "about:blank")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{PREFIX}{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PREFIX}{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """One gzip member whose header tells the member's length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = GZIP_MARK + b"\0\0\0\0\0\xff"
    total = len(head) + GZIP_EXTRA.size + len(body) + 8
    return head + GZIP_EXTRA.pack(12, b"R", b"L", 8, total) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def write_archives(pages: DataFrame, at: str, least_bytes: int = 0, compress: bool = True, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Write the pages; returns file, bytes and records of each archive."""
    small_batches(pages.sparkSession, 500)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        system, root = open_fs(at)
        done: list[tuple[str, int, int]] = []
        out, size, n = None, 0, 0

        def close() -> None:
            name = f"part-{task:06d}-{len(done):04d}.warc{'.gz' if compress else ''}"
            out.close()
            system.move(f"{root}/tmp-{attempt}", f"{root}/{name}")
            done.append((f"{at}/{name}", size, n))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                data = record_bytes(page_id, url, html.encode("utf-8"), refers_to)
                data = gzip_member(data) if compress else data
                if out is None:
                    out, size, n = system.open_output_stream(f"{root}/tmp-{attempt}"), 0, 0
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            f, b, r = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(b, pa.int64()), pa.array(r, pa.int64())], ["file", "bytes", "records"])

    rows = plan_records(pages, least_bytes).mapInArrow(task(write), "file string, bytes long, records long").collect()
    return [r.asDict() for r in sorted(rows)]


def plain_candidates(data: bytes, offset: int, stop: int, more: Callable[[int], bytes] | None = None) -> Iterator[tuple[int, int]]:
    """Record starts and the places behind their records; ``more`` reads on from an offset where
    a header doesn't end in ``data`` (a record's own end is the latest place where it can)."""
    at = data.find(PLAIN_MARK)
    while 0 <= at and offset + at < stop:
        end = data.find(b"\r\n\r\n", at)
        while end < 0 and more is not None and (extra := more(offset + len(data))):
            seen = max(at, len(data) - 3)
            data += extra
            end = data.find(b"\r\n\r\n", seen)
        if end >= 0 and (m := re.search(rb"\r\nContent-Length:[ \t]*(\d{1,18})", data[at : end + 2], re.I)):
            yield offset + at, offset + end + 4 + int(m[1]) + 4
        at = data.find(PLAIN_MARK, at + 1)


def gzip_candidates(data: bytes, offset: int, stop: int, more: object = None) -> Iterator[tuple[int, int]]:
    at = data.find(GZIP_MARK)
    while 0 <= at and offset + at < stop:
        if at + 10 + GZIP_EXTRA.size <= len(data):
            xlen, r, k, n, total = GZIP_EXTRA.unpack_from(data, at + 10)
            if (xlen, r, k, n) == (12, b"R", b"L", 8):
                yield offset + at, offset + at + total
        at = data.find(GZIP_MARK, at + 1)


def reachable(starts: np.ndarray, nexts: np.ndarray, size: int) -> np.ndarray:
    """Which candidates a chain from offset 0 comes to, by pointer jumping.

    ``starts`` must ascend. Raises if the chain doesn't end at ``size``.
    """
    n = len(starts)
    if n == 0 or starts[0] != 0:
        raise ValueError("no record at the start of the archive")
    place = np.searchsorted(starts, nexts)
    found = (place < n) & (starts[np.minimum(place, n - 1)] == nexts)
    jump = np.append(np.where(found, place, n), n)
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    steps = 1
    while steps <= n:
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        steps *= 2
    last = np.flatnonzero(reached[:n])[-1]
    if nexts[last] != size:
        raise ValueError(f"the chain of records breaks at offset {int(starts[last])}")
    return reached[:n]


def parse_record(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"^([^:\r\n]+):[ \t]*(.*?)\r?$", head.decode(), re.M))
    body = block[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    number = lambda name: None if (x := fields[name].strip("<>").removeprefix(PREFIX)) == "None" else int(x)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (digest_of(payload) != digest or len(payload) != int(fields["X-Payload-Bytes"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": int(fields["X-Payload-Bytes"]), "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To") if kind == "revisit" else None, "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, files: list[dict], with_payload: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives; ``files`` holds file and bytes of each."""
    schema = SCHEMA + (", url string, payload binary" if with_payload else "")
    splits = sum(-(-f["bytes"] // split_bytes) for f in files)
    if not splits:
        return spark.createDataFrame([], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, a in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = open_fs(file)
                with system.open_input_file(path) as f:
                    data = f.read_at(min(split_bytes + AHEAD_BYTES, size - a), a)
                    find = gzip_candidates if file.endswith(".gz") else plain_candidates
                    more = lambda b, f=f, size=size: f.read_at(min(AHEAD_BYTES, size - b), b) if b < size else b""
                    pairs = [(s, e) for s, e in find(data, a, min(a + split_bytes, size), more) if s < e <= size]
                s, e = zip(*pairs) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(s), pa.string()), pa.array([size] * len(s), pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["file", "size", "start", "next"])

    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    arrow = pa.schema([arrow.field(n) for n in names])

    def chain(found: pa.Table) -> pa.Table:
        found = found.sort_by("start")
        keep = reachable(found["start"].to_numpy(), found["next"].to_numpy(), found["size"][0].as_py())
        return found.select(["file", "start", "next"]).filter(pa.array(keep))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            rows, held = [], 0
            for file, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if opened[0] != file:
                    system, path = open_fs(file)
                    opened = (file, system.open_input_file(path))
                data = opened[1].read_at(e - s, s)
                rec = parse_record(zlib.decompress(data, 31) if file.endswith(".gz") else data)
                rows.append({k: rec[k] for k in names})
                held += rec["payload_bytes"] if with_payload else 0
                if held > split_bytes:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, arrow)

    each = spark.createDataFrame([(f["file"], f["bytes"]) for f in files if f["bytes"]], "file string, bytes long")
    each = each.select("file", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))
    found = each.repartition(splits).mapInArrow(task(scan), "file string, size long, start long, next long")
    # numbers of partitions by bytes: rows are few and small, what they point at is not
    kept = found.repartition(len(files), "file").groupBy("file").applyInArrow(chain, "file string, start long, next long")
    kept = kept.repartition(splits, "file", F.expr(f"start div {split_bytes}")).sortWithinPartitions("file", "start")
    return kept.mapInArrow(task(parse), schema)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, compress: bool = True, at: str | None = None) -> DataFrame:
    spark = pages.sparkSession
    files = write_archives(pages, at or fresh_dir(spark, "warc"), least_bytes, compress)
    return read_archives(spark, files)
