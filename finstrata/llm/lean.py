"""Small steps through Arrow batches, so that a Python worker's memory does not follow the size of the batches it is sent."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

ROWS = 512


def lean(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows``, without empty ones. Memory that is free goes back to the system after each batch and at the end of the task,
    since workers live on and share their executor's limit."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
