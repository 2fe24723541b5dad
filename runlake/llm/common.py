"""Helpers of this package: shared folder, checkpoints, Arrow batches, byte-level words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the integer mixes, fixed so that hashes are equal on every machine.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session may lack it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="runlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` kept in the shared folder, with their lineage cut; a lost executor loses none of them."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As :func:`cut`, but as compressed Parquet: for wide or large rows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it if ``docs`` has such a column already."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def with_text(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` from ``rows``, with another ``text`` and ``n_chars`` counted anew."""
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[changed.get(c, kept).alias(c) for c, kept in zip(docs.columns, columns_of(docs), strict=True)])


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read, as (doc_id, text), whatever else ``docs`` carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def give_back() -> None:
    """Returns to the system what a worker has freed but its allocators still hold: Spark keeps idle workers, whose memory adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batch: pa.RecordBatch, budget: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """An Arrow batch cut so that each slice holds about ``budget`` bytes of ``column`` (or one longer row).

    Several slices are copies, so that one which is still in use does not keep the whole batch.
    """
    if not batch.num_rows:
        return
    array = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // budget
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(edges, edges[1:], strict=False):
        yield batch if len(edges) == 2 else batch.take(pa.array(np.arange(start, stop)))


def slices(batches: Iterator[pa.RecordBatch], budget: int = 3 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The Arrow batches of a task as :func:`sliced`. None is kept while the next is read, nor by the worker when the task ends."""
    for batch in batches:
        yield from sliced(batch, budget, column)
        del batch
    give_back()


def raw_text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and where each row starts (with the total at the end); null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_B
        x = (x ^ (x >> np.uint64(27))) * MIX_A
        return x ^ (x >> np.uint64(31))


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_A)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Base of the polynomial hashes, and its inverse modulo 2^64.
POLYNOMIAL = int(MIX_A)
POLYNOMIAL_INVERSE = pow(POLYNOMIAL, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i from 0 to n."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1), np.uint64(base)))])


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of ``raw``, equal for equal contents (polynomial over random byte codes, then mixed)."""
    n = len(raw)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[raw] * powers(POLYNOMIAL, n)[:n])])
        back = powers(POLYNOMIAL_INVERSE, n)
        return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * MIX_B)


def byte_words(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: starts, ends, and the first word of each row (with the total at the end).

    ``blank`` tells which bytes are none of a word.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~blank[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)
