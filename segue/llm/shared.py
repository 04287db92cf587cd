"""Small helpers of this package: reading tables, row-count sizing, Arrow slicing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows no model may learn from; a NULL id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))


def text_slices(texts: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of a string array of about ``max_bytes`` each, so temporary
    arrays stay small whatever the batch; one very long text is a slice of its own."""
    sizes = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))
    row = 0
    while row < len(texts):
        done = sizes[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sizes, done + max_bytes, side="right")))
        yield row, texts.slice(row, end - row)
        row = end


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large-string array, NULL as the empty text (64-bit offsets: joined texts may pass 2 GB)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` that gives its memory back at its end: workers live on, and what one has kept is
    missing to the tasks beside the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run
