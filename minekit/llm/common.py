"""What the operators share: the shared folder, written tables, splits and word tokens."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words that the contracts speak of, as a pattern for Java and Python alike.
WORD = r"[^\x20\x09-\x0D]+"
_FALLBACK = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests, local mode)."""
    global _FALLBACK
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if _FALLBACK is None or not os.path.isdir(_FALLBACK):
            _FALLBACK = tempfile.mkdtemp(prefix="minekit-shared-")
            made = _FALLBACK
            atexit.register(lambda: __import__("shutil").rmtree(made, ignore_errors=True))
        found = f"file://{_FALLBACK}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it is removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/minekit-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: it does so when the driver's garbage is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % mod


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of a batch that Spark hands to Python; bytes of text that a kernel handles at once.
BATCH_ROWS, SLICE = 2048, 2 << 20
#: Bytes of a word that is hashed by arrays.
LONG = 32


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; its session from now on hands no more than BATCH_ROWS rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about SLICE bytes of text; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if sizes.sum() <= SLICE:
        if batch.num_rows:
            yield batch
        return
    lo = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > SLICE:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += size
    yield batch.slice(lo)


def give_back() -> None:
    """Hands memory that nothing uses any more back to the system: workers are reused, and what they keep adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def by_slices(column: str, ready: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: what ready() makes in the worker, applied to slices of the batches; memory is given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # kernels make no cycles, and their many small objects are costly to look through
        try:
            apply = ready()
            for batch in batches:
                for piece in slices(batch, column):
                    yield apply(piece)
        finally:
            apply = batch = piece = None
            gc.enable()
            give_back()

    return run


# Word tokens of Arrow batches


def fresh(texts: pa.Array) -> pa.Array:
    """Large strings without nulls, copied: some string kernels misread pieces of larger arrays."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


def tokens(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of words of each text, code of each word, the distinct words).

    Words are runs of anything but ASCII white space; with lower only A-Z change.
    Null texts have no words.
    """
    texts = fresh(texts)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, rows = parts.flatten(), np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not keep.all():
        flat, rows = flat.filter(pa.array(keep)), rows[keep]
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.bincount(rows, minlength=len(texts)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def distinct(values: np.ndarray) -> np.ndarray:
    """np.unique of whole numbers by sorting, which takes a fraction of its time."""
    out = np.sort(values)
    return out[np.concatenate([np.ones(min(1, len(out)), bool), out[1:] != out[:-1]])]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words: of up to LONG bytes by arrays, of longer ones one by one."""
    words = words.cast(pa.large_binary())
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size, out = np.diff(offsets), np.zeros(n, np.uint64)
    for k in range(1, LONG // 8 + 1):
        rows = np.flatnonzero((size + 7) // 8 == k)
        if len(rows):
            inside = np.arange(8 * k)
            at = np.minimum(offsets[rows][:, None] + inside, len(data) - 1)
            padded = np.where(inside < size[rows][:, None], data[at], np.uint8(0)).astype(np.uint8)
            parts = np.ascontiguousarray(padded).view("<u8")
            out[rows] = mix(*parts.T, size[rows].astype(np.uint64), seed=9)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(words[i].as_py())
    return out


def mix(*columns: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of aligned 64-bit columns, order counting."""
    out = np.full(len(columns[0]), (0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1), np.uint64)
    for c in columns:
        out = (out ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out
