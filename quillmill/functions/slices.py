"""Arrow batches worked on in slices.

A batch has as many rows as Spark gives it, whatever their size. What Python makes of a text is many times the text, so a function over
whole batches needs memory in proportion to ten thousand texts; over slices it needs that of one slice (or one text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on at a time.
SIZE = 1_000_000
#: The C library's way to give freed memory back, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _bytes(column: pa.Array) -> np.ndarray:
    """About how many bytes each value has: texts by their length, others by the average."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), column.nbytes // max(1, len(column)), np.int64)


def sliced(batches: Iterator[tuple[pa.Array, ...]], work: Callable[..., pa.Array], size: int = SIZE) -> Iterator[pa.Array]:
    """work(*columns) of each batch, in slices of about `size` bytes; a larger row is a slice by itself. What one slice took is given back
    before the next. An empty batch gives an empty result."""
    for columns in batches:
        total, at, n = np.cumsum(sum(_bytes(c) for c in columns)), 0, len(columns[0])
        while at < n or not n:
            base = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + size, "right")))
            yield work(*(c.slice(at, end - at) for c in columns))
            pa.default_memory_pool().release_unused()
            if _trim:
                _trim(0)
            if not n:
                break
            at = end
