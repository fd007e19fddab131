"""Pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts handled at once inside a Python worker, and their bytes (one longer text goes alone).
SLICE_ROWS, SLICE_BYTES = 256, 4_000_000


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of few rows and few bytes of text, so that few texts are Python objects at a time."""
    for batch in batches:
        if batch.num_rows and "text" in batch.schema.names:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
                yield batch.slice(at, stop - at)
                at = stop
        else:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    tidy()


def tidy() -> None:
    """Hand memory that a finished input used back to the system: workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library; nothing to hand back by hand


def arrow_schema(ddl: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in ddl])


def per_slice(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` of a function that turns one small batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            out = fn(part)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def fold_of(column: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; null for a null id."""
    return F.crc32(column.cast("string")) % F.lit(mod)


def fold_py(doc_id: object, mod: int) -> int:
    """Plain-Python twin of :func:`fold_of`."""
    return zlib.crc32(str(doc_id).encode()) % mod
