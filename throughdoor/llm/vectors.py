"""Embedding columns as exact integer matrices."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def scaled(column, scale: int, limit: int, dims: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The usable rows of a list column, and floor(scale * x) of each as int64.

    Usable is a vector that is not null, has no null and no non-finite component
    and, if ``dims`` is given, has that many. A component of ``limit`` or more
    after scaling is refused, since results could no longer be exact.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), -1)
    there = pc.greater_equal(length, 0) if dims is None else pc.equal(length, dims)
    rows = np.flatnonzero(there.to_numpy(zero_copy_only=False))
    lists = column.take(pa.array(rows))
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = bad[ends] == bad[ends - size]
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(flat * scale)
    if len(whole) and np.nanmax(np.where(np.isfinite(flat), np.abs(whole), 0)) >= limit:
        raise OverflowError(f"a component reaches {limit} after scaling by {scale}; exact integers end there")
    whole = np.where(np.isfinite(whole), whole, 0).astype(np.int64)
    return rows[good], [whole[b - n: b] for b, n in zip(ends[good].tolist(), size[good].tolist())]


def packed(vectors: list[np.ndarray], width: int) -> pa.Array:
    """Vectors as binaries of little-endian 32-bit integers, filled up with zeros to ``width``."""
    out = np.zeros((len(vectors), width), dtype="<i4")
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    ends = np.arange(len(vectors) + 1, dtype=np.int32) * (4 * width)
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(column, width: int) -> np.ndarray:
    """The matrix (int64) of a column made by ``packed``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), width).astype(np.int64)
