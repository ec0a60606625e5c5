"""Shared folders, staged tables and word batches for the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of characters other than the ASCII space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and every executor share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a local session (tests, a laptop)
    gets a temporary folder, chosen once and stored in it; a cluster is refused, as its
    executors would not share one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyfield.scratch.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyfield-")
        spark.conf.set("tallyfield.scratch.dir", at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, removed when the session's JVM ends."""
    at = f"{shared_dir(spark)}/tallyfield/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    hadoop = path.getFileSystem(spark._jsc.hadoopConfiguration())
    hadoop.mkdirs(path)
    hadoop.deleteOnExit(path)
    return at


def drop_dir(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, the
    work is done once, and a lost executor costs a reread instead of a recompute."""
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and the folder, for tables that can go before the session ends."""
    spark = df.sparkSession
    at = fresh_dir(spark, name)
    df.write.parquet(at + "/table")
    return spark.read.schema(df.schema).parquet(at + "/table"), at


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a long column that tells its rows apart, the same at every reading.

    The document ids serve if they do that; else rows are numbered in a staged copy, in order
    of id and text, so rows whose numbers depend on chance are equal in both.
    """
    n, distinct = docs.agg(F.count("*"), F.count_distinct(id_col)).first()
    if n == distinct:
        return docs.withColumn(name, F.col(id_col).cast("long"))
    order = [F.col(id_col).cast("long"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ordered.withColumn(name, F.monotonically_increasing_id()), "rows")


_HELD: dict = {}


def held(key: object, make: Callable[[], object]):
    """What a worker keeps from one task to the next: one thing, the last asked for."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drop what other operators' tasks left in this worker, and give its memory back."""
    _HELD.clear()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A batch function that begins and ends without memory of other work in its worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def small_batches(spark: SparkSession, records: int = 2000, megabytes: int = 16) -> None:
    """Bound what one Arrow batch holds: records and, for long texts, bytes.

    Workers on the driver's machine also get this package's folder on their path; a
    cluster ships the package (``--py-files``).
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; Hadoop's ``file:/x`` form is accepted."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def string_array(column) -> pa.Array:
    """A column of a batch as one large-string array, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of every text in order, and per text the bounds of its words.

    Returns the flat words and n + 1 bounds; empty pieces at either end of a text
    are dropped.
    """
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    counts = np.diff(parts.offsets.to_numpy())
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)[full]
        counts = np.bincount(owner, minlength=len(counts))
        flat = flat.filter(pa.array(full))
    return flat, np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def coded(flat: pa.Array) -> tuple[np.ndarray, list]:
    """Distinct values of an array and, per element, the position of its value."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator: a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(h: np.ndarray) -> np.ndarray:
    """Top 53 bits of a hash as a number in [0, 1)."""
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def slices(batch: pa.RecordBatch, column: str = "text", megabytes: float = 4) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of text, one text at least; no setting of the
    session is touched, so plans that run later keep their own batches."""
    n = batch.num_rows
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + int(megabytes * 2**20), side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings one behind the other, and their n + 1 bounds."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]
