"""Arrow batches cut into parts of bounded size.

Spark hands a task up to 64 MB of a column at once.  What Python makes of it
takes several times that, so tasks work on one small part after the other;
parts share the memory of their batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are Python strings at a time.
PART_BYTES = 4 << 20
#: Numbers or words of lists that are worked on at a time.
PART_VALUES = 1 << 19


def bounds(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` or that are one larger row, in order."""
    ends = np.cumsum(sizes, dtype=np.int64)
    low = 0
    while low < len(ends):
        done = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
        yield low, high
        low = high


def text_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def text_parts(batch: pa.RecordBatch, column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with at most ``most`` bytes in a text column, or of one longer text."""
    for low, high in bounds(text_sizes(batch.column(column)), most):
        yield batch.slice(low, high - low)
