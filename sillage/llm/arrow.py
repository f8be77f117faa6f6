"""Helpers for Arrow batches of whole texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession

#: Output rows are handed over once they hold about this many bytes.
FLUSH_BYTES = 8_000_000


def release() -> None:
    """Give memory that nothing uses back to the system: workers outlive their tasks, and share the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, with its memory released at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_rows(columns: list[str], types: list[pa.DataType], row: Callable[..., tuple], weigh: Callable[[tuple], int] = lambda out: 64) -> Callable:
    """A mapInArrow function that applies ``row`` to each input row and flushes by output size."""
    schema = pa.schema(list(zip(columns, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for i in range(batch.num_rows):
                out = row(*(c[i].as_py() for c in batch.columns))
                held.append(out)
                size += weigh(out)
                if size >= FLUSH_BYTES or len(held) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)

    return run


#: The session's setting for the rows of an Arrow batch.
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(spark: SparkSession, rows: int = 500) -> SparkSession:
    """Set the session up for rows that hold whole texts: fewer of them an Arrow batch than the default of 10,000."""
    if int(spark.conf.get(_ROWS)) <= 0 or int(spark.conf.get(_ROWS)) > rows:
        spark.conf.set(_ROWS, str(rows))
    return spark


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Fewer rows an Arrow batch while the block's jobs run, as whole texts are wide; the session's setting comes back after."""
    old = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, old)


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed bytes: the first of all, then the second of all, and so on, as the upper ones hardly vary."""
    planes = values.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()
