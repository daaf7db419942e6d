"""What the operators share: scratch tables, text batches, checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.scratch import Scratch  # noqa: F401

#: Rows of an Arrow batch that goes to Python; whole texts travel in it.
BATCH_ROWS = 512


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of long texts fits beside the JVM; workers find this package where the driver did."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def release_memory() -> None:
    """Gives freed memory back at the end of a task; its worker process lives on beside the next stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each text, or the bytes of a binary column; null gives empty bytes."""
    col = batch.column(column)
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    elif pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = memoryview(col.buffers()[2]) if col.buffers()[2] is not None else memoryview(b"")
    valid = None if col.null_count == 0 else np.asarray(col.is_valid())
    for i in range(len(col)):
        yield b"" if valid is not None and not valid[i] else bytes(data[offsets[i] : offsets[i + 1]])


def flat_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from all values in a row and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def flat_binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary column from all bytes in a row and the size of each value."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def small(df: DataFrame, most: int) -> bool:
    """Whether a table has at most so many rows; it is counted, never guessed."""
    return df.limit(most + 1).count() <= most


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int = 20_000) -> DataFrame:
    """A join that broadcasts the right side only after its rows were counted."""
    return left.join(F.broadcast(right) if small(right, most) else right, on, how)
