"""Words and word shingles of Arrow text columns, as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D. In UTF-8 that is the
code-point rule ``[^\\x20\\x09-\\x0D]+``, so texts are never decoded. A batch is
one byte array; every step below is a few passes over it, whatever the number
of documents in it.
"""
from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20  # text handled at once; a longer document is a piece of its own
PIECE_ROWS = 1000

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# everything but ASCII letters and the bytes of other characters
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_UNSTEP = pow(_STEP, -1, 1 << 64)


def trimmed(run: Callable) -> Callable:
    """A task's function that hands its memory back when the task ends.

    Python workers outlive their tasks, and the next stage's tasks should not
    find the memory of the last stage's texts still taken.
    """

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def trim() -> None:
    """Hand freed memory of this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_LOWER_BYTE = _BYTE[_LOWER]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        grown = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        grown[0] = 1
        held = np.multiply.accumulate(grown)
        if n <= 4 * PIECE_BYTES:  # do not hold on to the tables of one giant text
            _powers[base] = held
    return held[:n]


@dataclass
class Piece:
    """Some consecutive rows of a batch."""

    first: int
    data: np.ndarray  # bytes of the rows' texts, one after the other
    offsets: np.ndarray  # of each row in ``data``, and the end

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The rows of a text column in pieces of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for at in range(0, len(column), PIECE_ROWS):
        part = column.slice(at, PIECE_ROWS).cast(pa.large_string()).fill_null("")
        n = len(part)
        _, ends, data = part.buffers()
        offsets = np.frombuffer(ends, dtype=np.int64)[part.offset: part.offset + n + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), n)
            yield Piece(at + first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first])
            first = last


@dataclass
class Words:
    """Where the words of a piece begin and end, and which are whose."""

    start: np.ndarray  # byte positions
    end: np.ndarray
    bounds: np.ndarray  # words of row i are bounds[i]:bounds[i + 1]


def split(piece: Piece, gaps: np.ndarray = SPACE) -> Words:
    """The runs of bytes that are no ``gaps``."""
    solid = ~gaps[piece.data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = piece.offsets[:-1][piece.offsets[:-1] < len(solid)]
    begins[edges] = solid[edges]  # a text begins anew whatever stands before it
    ends = solid.copy()
    ends[:-1] &= begins[1:] | ~solid[1:]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, piece.offsets))


def word_hashes(piece: Piece, words: Words, *lengths: int) -> np.ndarray:
    """A 64-bit hash of every word, ASCII letters folded.

    With ``lengths``, a row of hashes for each: of the word's first so many
    bytes, or of all of a shorter word.
    """
    n = len(piece.data)
    terms = _LOWER_BYTE[piece.data]
    terms *= _power(_STEP, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.add.accumulate(terms, out=sums[1:])
    # the polynomial of a word, moved to position 0
    back, low = _power(_UNSTEP, n)[words.start], sums[words.start]
    if not lengths:
        return mix((sums[words.end] - low) * back)
    return np.stack([mix((sums[np.minimum(words.start + k, words.end)] - low) * back) for k in lengths])


_FOLD = np.uint64(0xD6E8FEB86659FD93)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows in order, and their bounds by row.

    A row of fewer than k words has one window: all its words. Without words it
    has none.
    """
    counts = np.diff(bounds)
    windows = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(windows)])
    if out_bounds[-1] == 0:
        return np.zeros(0, np.uint64), out_bounds
    at = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1] - bounds[:-1], windows)
    size = np.repeat(np.minimum(counts, k), windows)
    folded = hashes[at]
    short = bool((size < k).any())
    for j in range(1, k):
        if short:
            there = np.flatnonzero(size > j)
            x = folded[there]
            folded[there] = (x ^ (x >> np.uint64(29))) * _FOLD + hashes[at[there] + j]
        else:
            folded = (folded ^ (folded >> np.uint64(29))) * _FOLD + hashes[at + j]
    return mix(folded + size.astype(np.uint64)), out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of every row, ascending, and their bounds."""
    ordered = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ordered[a:b].sort()
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(ordered)]] = True
    upto = np.concatenate([[0], np.cumsum(fresh)])
    return ordered[fresh], upto[bounds]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[Piece, np.ndarray, np.ndarray]]:
    """Piece by piece: the distinct shingle hashes of every row, ascending."""
    for piece in pieces(column):
        found = split(piece)
        yield piece, *distinct(*shingles(word_hashes(piece, found), found.bounds, k))
