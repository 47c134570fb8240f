"""Memory of Python workers: they serve one task after another, and what one has freed should be there for the executor's other processes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from .shingles import forget

#: Rows of a batch that are worked on together.
TOGETHER = 1000


def give_back() -> None:
    """Returns what is free in this process to the system, as far as its allocators can."""
    forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving memory back before it begins and when it has ended."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what is made of one isn't held for all of a batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def by_parts(of: Callable[..., pa.Array], batches: Iterator[tuple[pa.Array, ...]], kind: pa.DataType, rows: int = TOGETHER) -> Iterator[pa.Array]:
    """of, which makes an array of kind, on each batch of columns for so many rows at a time: only Arrow's own form of a whole batch is held."""
    for columns in batches:
        parts = [of(*[c.slice(k, rows) for c in columns]) for k in range(0, len(columns[0]), rows)]
        yield pa.concat_arrays(parts) if parts else pa.array([], kind)
