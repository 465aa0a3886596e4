"""Helpers shared by the corpus operators: checkpoints, Arrow passes over texts, Bloom filters, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.workdir import checkpoint

#: Bits of a Bloom filter at most (64 MB when packed), so what is broadcast has a fixed bound. A fuller filter only
#: lets more rows through to the exact step that follows; results stay the same.
MAX_FILTER_BITS = 1 << 29
FILTER_HASHES = 4
_SEGMENT_BITS = 1 << 17
#: Slots that a task of a filter gathers at least before it sorts them into those it had.
_FOLD = 1 << 18
#: Slices in which vectors of counts are added up.
SLICES = 16
#: Text that a Python task holds as Python objects at once; a text that is longer is held alone.
SLICE_BYTES = 4_000_000
#: Bytes of an Arrow batch to Python, which both sides hold, and Spark's own value.
BATCH_BYTES, SPARKS_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def release(spark: SparkSession) -> None:
    """Let the driver drop what earlier rounds held: shuffle files, checkpoints and plans go with their last reference."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def rest() -> None:
    """Give what a task has freed back to the system: Python workers are used again, and would keep it for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, after which a task's memory is given back. Names with dots or backticks, which it can't take, are
    others meanwhile. Unless the session has a limit of its own, batches are as large as a slice from now on: 10,000 rows
    of text would be up to 64 MB, in the task and in its worker."""
    if df.sparkSession.conf.get(BATCH_BYTES) == SPARKS_BATCH_BYTES:
        df.sparkSession.conf.set(BATCH_BYTES, SLICE_BYTES)
    safe = lambda names: [f"{re.sub('[.`]', '_', c)}#{i}" if re.search("[.`]", c) else c for i, c in enumerate(names)]
    df, names = df.toDF(*safe(df.columns)), None
    if isinstance(schema, StructType) and safe(schema.names) != schema.names:
        names, schema = schema.names, StructType([StructField(c, f.dataType, f.nullable) for c, f in zip(safe(schema.names), schema, strict=True)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        rest()

    out = df.mapInArrow(task, schema)
    return out.toDF(*names) if names else out


def map_arrow(df: DataFrame, schema: str | StructType, batch_to_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = SLICE_BYTES) -> DataFrame:
    """Apply a function to slices of Arrow batches, of at most `most` bytes of text or of one row; None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                if part.num_rows and (out := batch_to_batch(part)) is not None:
                    yield out

    return map_batches(df, run, schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES, columns: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes in these columns, or of one row."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in set(columns) & set(batch.schema.names):
        sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    ends, low = np.cumsum(sizes), 0
    while low < batch.num_rows:
        high = int(np.searchsorted(ends, ends[low] - sizes[low] + most, "right"))
        high = max(low + 1, high)
        yield batch.slice(low, high - low)
        low = high


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Filter positions of 64-bit hashes, one row for each hash."""
    h = hashes.astype(np.int64, copy=False).view(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(FILTER_HASHES, dtype=np.uint64)
    return (((first[:, None] + k * step[:, None])) & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(rows: int) -> int:
    """About 16 bits a row, as a power of two between one segment and MAX_FILTER_BITS."""
    return int(min(MAX_FILTER_BITS, max(_SEGMENT_BITS, 1 << max(0, 16 * max(rows, 1) - 1).bit_length())))


def _bitmap(positions: np.ndarray) -> bytes:
    flags = np.zeros(_SEGMENT_BITS, dtype=bool)
    flags[positions] = True
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _segments(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """Rows (segment, bitmap of positions that were set, bitmap of those set again) of sorted positions."""
    found = np.unique(once // _SEGMENT_BITS)
    rows = []
    for s in found:
        low, high = s * _SEGMENT_BITS, (s + 1) * _SEGMENT_BITS
        cut = lambda x: x[np.searchsorted(x, low) : np.searchsorted(x, high)] - low  # noqa: E731, B023
        rows.append((int(s), _bitmap(cut(once)), _bitmap(cut(twice))))
    seg, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(seg, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["segment", "once", "twice"])


def build_filter(hashes: DataFrame, bits: int, repeated_only: bool) -> np.ndarray:
    """Packed Bloom filter of the one bigint column of `hashes`.

    Each task makes its part of two filters: what it met, and what it met again. The parts meet segment by segment, so
    no task holds more than its segments whatever the number of rows. With repeated_only the second filter is the
    result: a hash outside it occurs once in the whole input. Only a filter of at most MAX_FILTER_BITS reaches the driver.
    """
    name = hashes.columns[0]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, fresh, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def fold() -> None:
            nonlocal once, twice, fresh, held
            slots, n = np.unique(np.concatenate(fresh), return_counts=True)
            twice = np.unique(np.concatenate([twice, slots[n > 1], np.intersect1d(once, slots, assume_unique=True)]))
            once, fresh, held = np.union1d(once, slots), [], 0

        for batch in batches:
            fresh.append(_slots(batch.column(name).drop_null().to_numpy(zero_copy_only=False), bits).ravel())
            held += len(fresh[-1])
            if held > max(_FOLD, len(once)):  # so each slot is sorted a few times at most
                fold()
        if held:
            fold()
        if len(once):
            yield _segments(once, twice)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for seg, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if seg in met:
                    had = met[seg]
                    had[1] |= b | (had[0] & a)
                    had[0] |= a
                else:
                    met[seg] = [a.copy(), b.copy()]
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int64()), pa.array([zlib.compress(v[repeated_only].tobytes(), 1) for v in met.values()], pa.binary())], names=["segment", "bits"])

    parts = map_batches(hashes, part, "segment bigint, once binary, twice binary")
    tasks = int(max(1, min(bits // _SEGMENT_BITS, 64)))
    out = np.zeros(bits // 8, np.uint8)
    for seg, packed in map_batches(parts.repartition(tasks, "segment"), merge, "segment bigint, bits binary").collect():
        out[seg * _SEGMENT_BITS // 8 : (seg + 1) * _SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return out


def may_hold(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes might be in the filter."""
    slots = _slots(hashes, len(packed) * 8)
    return ((packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=1)


def in_filter(spark: SparkSession, packed: np.ndarray) -> Callable[[Column], Column]:
    """A column function: might the hash be in the filter? Null never is."""
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, h.fillna(0).to_numpy(np.int64)))

    return lambda c: c.isNotNull() & test(F.coalesce(c, F.lit(0)))


def row_key(of: str = "") -> Column:
    """What tells rows apart: the id (null is an id, the largest) and two hashes of the text. of: prefix of the columns."""
    id_, text = F.col(f"{of}doc_id"), F.col(f"{of}text")
    return F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of docs whose row_key() isn't in dropped (one column). A Bloom filter of the dropped keys routes the few rows
    that may go through an anti join; all other rows, whole texts with them, aren't shuffled. The table's columns are held
    in one struct meanwhile, so none of their names can clash."""
    spark = docs.sparkSession
    dropped = checkpoint(dropped.select(F.col(dropped.columns[0]).alias("gone")).distinct())
    n = dropped.count()
    if not n:
        return docs
    maybe = in_filter(spark, build_filter(dropped.select(F.xxhash64("gone").alias("h")), filter_bits(n), False))
    rows = docs.select(F.struct("*").alias("row")).select("row", row_key("row.").alias("own"))
    flag = maybe(F.xxhash64("own"))
    same = F.col("own.id").eqNullSafe(F.col("gone.id")) & (F.col("own.h") == F.col("gone.h")) & (F.col("own.h2") == F.col("gone.h2"))
    return rows.filter(~flag).unionByName(rows.filter(flag).join(dropped, same, "left_anti")).select("row.*")


def summed(parts: DataFrame, size: int, number: int = SLICES) -> np.ndarray:
    """Sum of the int64 vectors of fixed length `size` in rows (slice int, counts binary), made by sliced().

    The parts of all tasks meet slice by slice and are added one after the other, so a task holds its slices' sums
    alone; the total of fixed size is what reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(s, np.zeros(size // number, np.int64)).__iadd__(np.frombuffer(zlib.decompress(c), np.uint32))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros((number, size // number), np.int64)
    for s, counts in map_batches(parts.repartition(max(1, number // 4), "slice"), run, "slice int, counts binary").collect():
        out[s] = np.frombuffer(zlib.decompress(counts), np.int64)
    return out.ravel()


def sliced(counts: np.ndarray, number: int = SLICES) -> list[bytes]:
    """A task's vector of counts as compressed slices of uint32."""
    return [zlib.compress(c.tobytes(), 1) for c in counts.astype(np.uint32).reshape(number, -1)]


def score_texts(docs: DataFrame, scorer: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """doc_id and score of every row; `scorer` gets whole texts as bytes, a slice at a time."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(texts_of(batch)), pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), f"doc_id {kind}, score double", run)


def learnable(labels: DataFrame, label: str, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """The label rows outside the held-out part."""
    return labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int | dict[int, int]) -> DataFrame:
    """label and text of at most `rows` labelled documents (or so many of each label) outside the held-out part, the first
    by a hash of the id. The ids are broadcast; their number is the bound."""
    ranked = learnable(labels, label).select(F.col("doc_id").alias("__id"), F.col(label).cast("double").alias("label"))
    first = lambda df, n: df.orderBy(F.xxhash64("__id"), "__id").limit(max(1, n))
    parts = [first(ranked.filter(F.col("label") == k), n) for k, n in rows.items()] if isinstance(rows, dict) else [first(ranked, rows)]
    chosen = reduce(DataFrame.unionByName, parts)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("label", "text")
