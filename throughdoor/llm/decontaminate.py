"""Benchmark decontamination: SimHash of item-sized windows.

A window of a document as long as a benchmark item gets a 128-bit SimHash of its
weighted word shingles. Fingerprints are cut into bytes; if two differ in at
most ``radius`` bits, some byte of theirs differs in at most ``radius // 16``, so
looking up every byte's neighbours finds all items within the radius. Only these
are compared with the window, by the exact weight of the shingles they share.

Weights are nearly even, so no long word can turn a fingerprint: a shingle
weighs 5, 6 or 7 as it has fewer than 32, fewer than 64, or more bytes. With a
shingle that occurs n times adding the root of n times its weight, the cosine of
what the signs are taken from is at least the share of the item's weight that
the window holds, times the root of item's over window's total. At a share of
0.8 that is 0.77, where 28 of 128 bits differ on average, with a deviation of
4.7: the radius of 47 is four deviations off.

Only windows that hold a shingle of an item in its place can reach the
threshold, so fingerprints are made for those alone. The benchmark goes to the
tasks in blocks of a stated size, each a pass over the documents; nothing is
shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from throughdoor.llm import words


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    least: float = 0.8  # share of an item's weight that a window must hold
    radius: int = 47  # bits of 128, see above
    block_bytes: int = 8 << 20  # benchmark text in one pass


WIDTH = 16  # bytes of a fingerprint
TEXT_BYTES = 1 << 18  # text searched at once: its arrays take some thirty times that


def shingle_weights(size: np.ndarray) -> np.ndarray:
    """5, 6 or 7: what shingles of so many bytes count."""
    return 5 + (size >= 32).astype(np.int64) + (size >= 64)


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprints, ``WIDTH`` bytes each, of the rows of (windows, shingles) hashes and weights."""
    out = np.zeros((len(hashes), WIDTH), dtype=np.uint8)
    wide = hashes.shape[1]
    step = max(1, (1 << 14) // max(wide, 1))
    for at in range(0, len(hashes), step):
        h, w = hashes[at: at + step], weights[at: at + step]
        order = np.argsort(h, axis=1)
        h, w = np.take_along_axis(h, order, 1), np.take_along_axis(w, order, 1)
        # what occurs n times adds the root of n times its weight: each time a part of it
        run = np.cumsum(np.concatenate([np.ones((len(h), 1), bool), h[:, 1:] != h[:, :-1]], axis=1), axis=1) - 1
        run += np.arange(len(h))[:, None] * wide
        w = np.rint(64 * np.sqrt(w / np.bincount(run.ravel())[run])).astype(np.float32)  # sums stay exact
        more = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.unpackbits(np.stack([h, more ^ (more >> np.uint64(29))], axis=2).view(np.uint8), axis=2)
        signs = np.matmul(w[:, None, :], bits.astype(np.float32))[:, 0] * 2 - w.sum(axis=1, keepdims=True)
        out[at: at + step] = np.packbits(signs > 0, axis=1)
    return out


@dataclass
class HammingIndex:
    """Fingerprints under each of their bytes."""

    prints: np.ndarray  # (rows, bytes)
    radius: int

    def __post_init__(self):
        width = self.prints.shape[1]
        every = np.arange(256, dtype=np.uint8)
        self.turned = every[np.bitwise_count(every) <= self.radius // width]  # a byte's neighbours
        self.first = np.arange(width) * 256
        key = (self.prints + self.first).T.ravel()  # byte by byte
        order = np.argsort(key, kind="stable")
        self.rows = order % len(self.prints)
        self.starts = np.searchsorted(key[order], np.arange(256 * width + 1))

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (place in ``asked``, place in ``prints``, distance) within the radius."""
        found = [np.zeros((3, 0), np.int64)]
        step = max(1, (1 << 20) // (self.first.size * len(self.turned) + 4 * len(self.prints)))
        for at in range(0, len(asked), step):
            key = ((asked[at: at + step, :, None] ^ self.turned) + self.first[:, None]).reshape(-1)
            low = self.starts[key]
            n = self.starts[key + 1] - low
            which = np.flatnonzero(n)
            low, n = low[which], n[which]
            q = np.repeat(at + which // (self.first.size * len(self.turned)), n)
            place = self.rows[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            far = np.bitwise_count(asked[q].view(np.uint64) ^ self.prints[place].view(np.uint64)).sum(axis=1)
            good = far <= self.radius
            found.append(np.unique(np.stack([q, place, far.astype(np.int64)])[:, good], axis=1))
        return tuple(np.concatenate(found, axis=1))


class Screen:
    """A block of the benchmark, ready to be looked for in texts."""

    def __init__(self, ids: list, texts: list[str], use: Settings):
        self.use, self.ids = use, []
        self.sizes: list[int] = []  # words of each item
        self.items: list[tuple[np.ndarray, np.ndarray]] = []  # shingle hashes and weights, in order
        for piece in words.pieces(pa.array(texts, pa.string())):
            found = words.split(piece)
            hashes, weight = words.word_hashes(piece, found), found.end - found.start
            for i, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist())):
                if b > a:
                    self.ids.append(ids[piece.first + i])
                    self.sizes.append(b - a)
                    self.items.append(self._shingled(hashes[a:b], weight[a:b], min(use.shingle, b - a)))
        # places of every shingle in the items, by shingle length
        self.places: dict[int, tuple] = {}
        sizes = np.array(self.sizes, dtype=np.int64)
        for k in sorted({min(use.shingle, n) for n in self.sizes}):
            which = [i for i, n in enumerate(self.sizes) if min(use.shingle, n) == k]
            value = np.concatenate([self.items[i][0] for i in which])
            item = np.repeat(which, [len(self.items[i][0]) for i in which])
            offset = np.concatenate([np.arange(len(self.items[i][0])) for i in which])
            order = np.argsort(value, kind="stable")
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[(value >> np.uint64(44)).astype(np.int64)] = True
            self.places[k] = (value[order], item[order], offset[order], sieve)
        # one Hamming index per item size
        self.index: dict[int, tuple[np.ndarray, HammingIndex]] = {}
        for n in sorted(set(self.sizes)):
            which = np.flatnonzero(sizes == n)
            prints = simhash(*(np.stack([self.items[i][j] for i in which]) for j in (0, 1)))
            self.index[n] = (which, HammingIndex(prints, use.radius))

    @staticmethod
    def _shingled(hashes: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows, and their weights."""
        upto = np.concatenate([[0], np.cumsum(weight)])
        return words.shingles(hashes, np.array([0, len(hashes)]), k)[0], shingle_weights(upto[k:] - upto[:-k])

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Share of the item's weight whose shingles the window holds, repeats counted."""
        value, weight = self.items[item]
        mine, first, n = np.unique(value, return_index=True, return_counts=True)
        theirs, m = np.unique(window, return_counts=True)
        at = np.searchsorted(theirs, mine)
        at[at == len(theirs)] = 0
        shared = np.where(theirs[at] == mine, np.minimum(n, m[at]), 0)
        return float((shared * weight[first]).sum() / weight.sum())

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item, first word, words, distance, similarity): the best window of every pair."""
        k_all = self.use.shingle
        for piece in words.pieces(column, TEXT_BYTES):
            found = words.split(piece)
            hashes, length = words.word_hashes(piece, found), found.end - found.start
            bounds = found.bounds
            windows = []  # (row, item size, first word)
            for k, (value, item, offset, sieve) in self.places.items():
                flat, of = words.shingles(hashes, bounds, k)
                at = np.flatnonzero(sieve[(flat >> np.uint64(44)).astype(np.int64)])
                a, b = np.searchsorted(value, flat[at], "left"), np.searchsorted(value, flat[at], "right")
                at, a, n = at[b > a], a[b > a], (b - a)[b > a]
                if len(at) == 0:
                    continue
                row = np.searchsorted(of, at, side="right") - 1
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                size = np.array(self.sizes)[item[place]]
                row, first = np.repeat(row, n), np.repeat(at - of[row], n) - offset[place]
                total = np.diff(bounds)[row]
                first = np.clip(first, 0, np.maximum(total - size, 0))
                windows.append(np.stack([row, size, first]))
            if not windows:
                continue
            windows = np.unique(np.concatenate(windows, axis=1), axis=1)
            best: dict[tuple[int, int], tuple] = {}
            for size in np.unique(windows[1]).tolist():
                rows, firsts = windows[0][windows[1] == size], windows[2][windows[1] == size]
                k = min(k_all, size)
                shown, prints = [], np.zeros((len(rows), WIDTH), dtype=np.uint8)
                for i, (row, first) in enumerate(zip(rows.tolist(), firsts.tolist())):
                    a = bounds[row] + first
                    b = min(a + size, bounds[row + 1])
                    shown.append(self._shingled(hashes[a:b], length[a:b], k) if b - a >= k else None)
                full = [i for i, x in enumerate(shown) if x is not None and len(x[0]) == size - k + 1]
                for i in (i for i, x in enumerate(shown) if x is not None and len(x[0]) < size - k + 1):
                    prints[i] = simhash(shown[i][0][None], shown[i][1][None])[0]
                if full:
                    prints[full] = simhash(*(np.stack([shown[i][j] for i in full]) for j in (0, 1)))
                which, index = self.index[size]
                for q, p, far in zip(*(x.tolist() for x in index.near(prints))):
                    if shown[q] is None:
                        continue
                    item = int(which[p])
                    alike = self.similarity(item, shown[q][0])
                    if alike >= self.use.least:
                        key, rank = (int(rows[q]), item), (-alike, int(firsts[q]), far)
                        if key not in best or rank < best[key][0]:
                            best[key] = (rank, size)
            for (row, item), ((alike, first, far), size) in sorted(best.items()):
                yield piece.first + row, item, first, size, far, -alike


def screens(benchmark: DataFrame, use: Settings) -> Iterator[Screen]:
    """The benchmark (item_id, text) in blocks of about ``block_bytes``; null texts match nothing."""
    items = benchmark.where("text IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // use.block_bytes)
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).toArrow()
        yield Screen(part["item_id"].to_pylist(), part["text"].to_pylist(), use)


def contaminated(docs: DataFrame, benchmark: DataFrame, use: Settings = Settings()) -> DataFrame:
    """One row per document and benchmark item that the document holds.

    doc_id, item_id, first_word and n_words of the best window (the first of
    equals), distance of the fingerprints, similarity: the share, by weight, of
    the item's word shingles that the window holds, at least ``least``. Words
    are runs of non-white-space, A-Z lower-cased. An item of fewer words than a
    shingle is one shingle. Null and empty texts, on either side, match
    nothing; rows and items that repeat are each reported.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, first_word long, n_words long, distance long, similarity double"
    names = ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"]
    types = [pa.int64()] * 5 + [pa.float64()]

    def look(screen: Screen):
        @words.trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(screen.hits(batch.column(1)))
                ids = batch.column(0).take(pa.array([h[0] for h in found], pa.int64())).to_pylist()
                table = [(d, screen.ids[i], *rest) for d, (_, i, *rest) in zip(ids, found)]
                columns = list(zip(*table)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        return run

    out = spark.createDataFrame([], schema)
    for screen in screens(benchmark, use):
        out = out.union(rows.mapInArrow(look(screen), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, use: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; same columns."""

    def keep(screen: Screen, at: int):
        @words.trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 1000):
                    part = batch.slice(first, 1000)
                    good = np.ones(part.num_rows, dtype=bool)
                    for hit in screen.hits(part.column(at)):
                        good[hit[0]] = False
                    yield part.filter(pa.array(good))

        return run

    at = docs.columns.index("text")
    for screen in screens(benchmark, use):
        docs = docs.mapInArrow(keep(screen, at), docs.schema)
    return docs
