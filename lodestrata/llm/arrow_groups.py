"""Key runs in a sorted Arrow stream, slices of texts of bounded size, and workers that give memory back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal keys; a run may span batches.

    Only the current run is held, so memory is bounded by the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = np.asarray(batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False))
            changed[1:] |= values[1:] != values[:-1]
        cuts = [*np.flatnonzero(changed).tolist(), batch.num_rows]
        if held:
            last, row = held[-1], {k: batch.column(batch.schema.get_field_index(k))[0] for k in keys}
            if any(last.column(last.schema.get_field_index(k))[-1] != v for k, v in row.items()):
                yield pa.Table.from_batches(held)
                held = []
        begin = 0
        for i, cut in enumerate(cuts):
            held.append(batch.slice(begin, cut - begin))
            if i < len(cuts) - 1:
                yield pa.Table.from_batches(held)
                held = []
            begin = cut
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, width: int, dtype) -> np.ndarray:
    """A list column whose lists all have ``width`` members."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False)).astype(dtype, copy=False).reshape(-1, width)


def lists(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    """The members of each list, as views on one array."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False)).view(dtype)
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return [values[e - s : e] for s, e in zip(sizes, ends)]


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of neighbouring texts that hold about ``most`` bytes together; a longer text is alone."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, column.slice(begin, end - begin)
        begin = end


def _trim() -> None:
    """Hand freed memory back to the system; a worker outlives its task and would keep it from the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with the pool emptied after each batch and freed memory returned at the end."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield batch
                del batch
                pa.default_memory_pool().release_unused()
        finally:
            _trim()
    return wrapped
