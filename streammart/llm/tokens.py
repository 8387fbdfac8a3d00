"""Arrow-batch helpers shared by the operators that run in Python."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows are handled in slices of about so many bytes of text, whatever the batch size.
SLICE_BYTES = 4 << 20


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The bytes of each text as they are, well-formed UTF-8 or not; null is empty."""
    for x in batch.column(column).cast(pa.large_binary()):
        yield x.as_py() or b""


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that none holds much more than ``size`` bytes of text, SLICE_BYTES if not given (one row at least)."""
    for batch in batches:
        whole = batch.column(column).nbytes
        rows = max(1, int(batch.num_rows * (size or SLICE_BYTES) / max(1, whole)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Hands freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow; when its task ends, what it held goes back to the system.

    Python workers wait for further tasks beside the executor's heap, so what they keep counts.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped
