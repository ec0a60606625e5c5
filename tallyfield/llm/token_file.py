"""Token ids as binary shards: one concatenated id array, Elias-Fano document bounds.

Readers hold a shard's Elias-Fano bytes and select the bounds of some documents at a time;
no table of offsets is built.

A shard holds the documents of one range of ids, ascending:

    magic | ids, little-endian, 2 bytes where the vocabulary allows, else 4
          | Elias-Fano: document bounds (n + 1 offsets into the ids of this shard)
          | Elias-Fano: document ids less the smallest | footer (JSON) | its length | magic

Shards are written by the tasks that own them, under a name of the task attempt and then
renamed, so a task that is run again leaves the same bytes. The manifest (one line a
shard) is all that the driver holds.

Nulls and odd input: a null text counts as empty and yields only the end id; a null
document id comes first and is read back as null; repeated ids are kept, ordered by text; a
very long text is read and encoded by itself; an empty table gives no shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import fresh_dir, held, open_fs, small_batches, string_array, task, text_or_empty
from tallyfield.llm.elias_fano import EliasFano
from tallyfield.llm.pieces import PieceTable, encode_batch

MAGIC = b"IDSHARD1"
SLICE = 1 << 20  # ids read at a time, or one document's
SELECTED = 4096  # bounds selected at a time


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.no_truncation()
    tk.no_padding()
    return tk


def _piece_table(path: str) -> PieceTable:
    return held(("ids", path), lambda: PieceTable(_tokenizer(path), with_ids=True))


def write_token_file(docs: DataFrame, at: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every text, append ``end_id`` to each, write shards under ``at``.

    Returns the manifest in ascending order: file, documents, ids and the number of ids
    before the shard.
    """
    spark = docs.sparkSession
    small_batches(spark, 2000, 8)
    width = 2 if max(end_id + 1, _tokenizer(tokenizer).get_vocab_size()) <= 1 << 16 else 4
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
        .repartitionByRange("id", F.substring("text", 1, 32))  # rows of one id, or of none, needn't share a shard
        .sortWithinPartitions("id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        table = _piece_table(tokenizer)
        lens: list[np.ndarray] = []
        ids_of_docs: list[np.ndarray] = []
        nulls = n_ids = 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system, path = open_fs(f"{at}/part-{shard:06d}.ids")
                out = system.open_output_stream(f"{path}.{attempt}")
                out.write(MAGIC)
            n, ids = encode_batch(string_array(batch.column(1)), table)
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, end_id)
            out.write(ids.astype(f"<u{width}").tobytes())
            lens.append(n + 1)
            n_ids += len(ids)
            keys = batch.column(0)
            nulls += keys.null_count
            ids_of_docs.append(keys.drop_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        keys = np.concatenate(ids_of_docs).astype(np.int64)
        least = int(keys[0]) if len(keys) else 0
        bounds = EliasFano.of(np.concatenate(([0], np.cumsum(np.concatenate(lens))))).to_bytes()
        names = EliasFano.of(keys - least).to_bytes()
        n_docs = nulls + len(keys)
        footer = json.dumps({"width": width, "docs": n_docs, "ids": n_ids, "nulls": nulls, "least": least, "bounds": len(bounds), "names": len(names)}).encode()
        out.write(bounds + names + footer + struct.pack("<I", len(footer)) + MAGIC)
        out.close()
        system.move(f"{path}.{attempt}", path)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([n_docs], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    rows = sorted(ordered.mapInArrow(task(write), "shard int, docs long, ids long").collect())
    manifest, before = [], 0
    for r in rows:
        manifest.append({"file": f"{at}/part-{r.shard:06d}.ids", "docs": r.docs, "ids": r.ids, "before": before})
        before += r.ids
    return manifest


class Shard:
    """Random access to one shard file; only footers and bounds are held."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is not a complete shard")
        (n,) = struct.unpack("<I", tail[:4])
        self.meta = json.loads(self.file.read_at(n, size - 12 - n))
        at = len(MAGIC) + self.meta["ids"] * self.meta["width"]
        self.bounds = EliasFano.from_bytes(self.file.read_at(self.meta["bounds"], at))
        self.names = EliasFano.from_bytes(self.file.read_at(self.meta["names"], at + self.meta["bounds"]))

    def ids(self, start: int, stop: int) -> np.ndarray:
        w = self.meta["width"]
        return np.frombuffer(self.file.read_at((stop - start) * w, len(MAGIC) + start * w), f"<u{w}")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard, its bounds found by selection."""
        start, stop = self.bounds.select(np.array([i, i + 1]))
        return self.ids(int(start), int(stop))

    def doc_ids(self, low: int, high: int) -> pa.Array:
        """Document ids of the documents low, ..., high - 1 of the shard, by selection."""
        nulls = self.meta["nulls"]
        first = min(max(low, nulls), high)
        some = self.names.select(np.arange(first - nulls, high - nulls)) if first < high else np.zeros(0, np.int64)
        return pa.concat_arrays([pa.nulls(first - low, pa.int64()), pa.array(some + self.meta["least"], pa.int64())])


def read_token_file(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Per document: doc_id, start, n_tokens and the crc32 of its ids as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                for low in range(0, shard.meta["docs"], SELECTED):
                    high = min(low + SELECTED, shard.meta["docs"])
                    bounds, names = shard.bounds.select(np.arange(low, high + 1)), shard.doc_ids(low, high)
                    i = 0
                    while i < high - low:
                        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, side="right")) - 1)
                        ids = shard.ids(int(bounds[i]), int(bounds[j])).astype("<u4")
                        cut = bounds[i : j + 1] - bounds[i]
                        crc = [zlib.crc32(ids[cut[k] : cut[k + 1]].tobytes()) for k in range(j - i)]
                        yield pa.RecordBatch.from_pydict({"doc_id": names.slice(i, j - i), "start": pa.array(bounds[i:j] + row["before"], pa.int64()), "n_tokens": pa.array(np.diff(cut), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                        i = j

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(m["file"], m["before"]) for m in manifest], "file string, before long")
    return shards.repartition(len(manifest)).mapInArrow(task(read), schema)


def token_file(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, at: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token shards and return what reading them back gives."""
    spark = docs.sparkSession
    manifest = write_token_file(docs, at or fresh_dir(spark, "token-file"), tokenizer or vocabulary_path(), end_id, id_col, text_col)
    return read_token_file(spark, manifest)
