"""Hard negatives by angular triangle filtering.

Every vector is stored with its angles to a few reference directions. For an
anchor and a row, the difference of their angles to a reference is at most the
angle between them, and the sum (or what is left of a full turn) is at least
that; all references together give an interval of the cosine, times both
lengths one of the score. It is widened beyond any rounding. Only pairs whose
interval meets what is asked for get their integer score: for positives, what
can still come among the anchor's best; for negatives, the score windows under
its positives.

Anchors are a stated share of all rows. They are worked in blocks of bounded
bytes, each two passes over the rows; a task keeps the best few of each
anchor, and only those are shuffled.

Defined results: a row without label or vector, or with a null or non-finite
component, takes no part. A vector shorter than the longest is filled up with
zeros; an empty one and a zero vector score 0 with all. A null id is no
anchor and comes behind all other ids in ties. Repeated rows are rows of their
own: a copy of an anchor is another row, and a positive like others. An anchor
without positives or without negatives in a window has no row for it. An empty
table gives an empty result. Columns besides id, vector and label are not
read. Components so large that scores pass 2**53 are refused.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from throughdoor.llm import vectors
from throughdoor.llm.stored import Shelf


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    every: int = 100  # rows whose id is divisible by this are anchors
    positives: int = 5
    negatives: int = 5
    low: int = 80  # a negative's score is at least this many hundredths of the positive's
    high: int = 100  # and at most this many
    references: int = 12
    slack: float = 1e-6  # radians; rounding of stored angles is below 4e-7
    block_bytes: int = 8 << 20  # anchors in one pass


ROW_CHUNK, ANCHOR_CHUNK = 2048, 128
_NONE = np.iinfo(np.int64).min


def score_limit(width: int) -> int:
    """Components below this keep every score below 2**53, where doubles are exact."""
    return math.isqrt((1 << 53) // max(width, 1))


def lengths_and_angles(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    cosine = (x @ references.T) / np.where(length > 0, length, 1)[:, None]
    return length, np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def score_bounds(length_a, angle_a, length_x, angle_x, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest scores that the angles allow, for all pairs (a, x)."""
    shape = len(length_a), len(length_x)
    least, most = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32)
    for a, x in zip(angle_a.T, angle_x.T):
        total = a[:, None] + x[None, :]
        np.minimum(most, np.minimum(total, np.float32(2 * np.pi) - total), out=most)
        np.maximum(least, np.abs(a[:, None] - x[None, :]), out=least)
    size = length_a[:, None] * length_x[None, :]
    spare = 1 + 1e-9 * size
    low = size * np.cos(np.minimum(most.astype(np.float64) + slack, np.pi)) - spare
    high = size * np.cos(np.maximum(least.astype(np.float64) - slack, 0)) + spare
    return low, high


@dataclass
class Rows:
    """Some rows, as arrays."""

    row: np.ndarray
    id: np.ndarray
    lost: np.ndarray  # the id is null
    label: np.ndarray
    v: np.ndarray
    length: np.ndarray
    angle: np.ndarray

    COLUMNS = ("row", "id", "label", "v", "length", "angle")

    @classmethod
    def of(cls, table, width: int) -> Rows:
        column = {n: table.column(n) for n in cls.COLUMNS}
        array = lambda n: column[n].to_numpy(zero_copy_only=False) if isinstance(column[n], pa.Array) else column[n].to_numpy()
        angle = column["angle"].to_pylist()
        return cls(array("row"), column["id"].fill_null(0).to_numpy(), np.asarray(column["id"].is_null()),
                   array("label"), vectors.unpacked(column["v"], width).astype(np.float64), array("length"),
                   np.frombuffer(b"".join(angle), dtype="<f4").reshape(len(angle), -1))

    def part(self, at) -> Rows:
        return Rows(*(getattr(self, f)[at] for f in ("row", "id", "lost", "label", "v", "length", "angle")))


class Best:
    """The first k of every slot: higher scores first, ties by smaller id (null last), then row."""

    FIELDS = ("slot", "score", "lost", "id", "row")

    def __init__(self, slots: int, k: int):
        self.k = k
        self.held = [np.zeros(0, bool if f == "lost" else np.int64) for f in self.FIELDS]
        self.least = np.full(slots, _NONE)  # score of the k-th, once there are k

    def offer(self, slot, score, lost, id_, row) -> None:
        good = score >= self.least[slot]
        if not good.any():
            return
        slot, score, lost, id_, row = (
            np.concatenate([h, new[good]]) for h, new in zip(self.held, (slot, score, lost, id_, row)))
        order = np.lexsort((row, id_, lost, -score, slot))
        place = np.arange(len(order)) - np.searchsorted(slot[order], slot[order])
        order = order[place < self.k]
        self.held = [f[order] for f in (slot, score, lost, id_, row)]
        last = place[place < self.k] == self.k - 1
        self.least[self.held[0][last]] = self.held[1][last]


def pairs_of(anchors: Rows, batches: Iterator[pa.RecordBatch], width: int, slack: float, wanted):
    """Chunk by chunk: the rows, and the (anchor, row, score) of the pairs that ``wanted`` asks for.

    ``wanted`` takes (anchors' slice, rows, low, high) and gives a mask of pairs
    to be scored.
    """
    for b in batches:
        table = Rows.of(b, width)
        for first in range(0, len(table.row), ROW_CHUNK):
            rows = table.part(slice(first, first + ROW_CHUNK))
            for begin in range(0, len(anchors.row), ANCHOR_CHUNK):
                here = slice(begin, begin + ANCHOR_CHUNK)
                some = anchors.part(here)
                mask = wanted(here, rows, *score_bounds(some.length, some.angle, rows.length, rows.angle, slack))
                asked, met = mask.any(axis=1).nonzero()[0], mask.any(axis=0).nonzero()[0]
                if len(asked):
                    # integers below 2**53, so doubles are exact
                    score = (some.v[asked] @ rows.v[met].T).astype(np.int64)
                    a, x = mask[np.ix_(asked, met)].nonzero()
                    yield rows, asked[a] + begin, met[x], score[a, x]


def prepared(df: DataFrame, id_column: str, vector: str, label: Column, use: Settings) -> tuple[DataFrame, int]:
    """(id, label, v, length, angle) of the rows that take part, and the width of v."""
    spark = df.sparkSession
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"),
                     F.col(vector).alias("x")).where(F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    width = max(rows.agg(F.max(F.size("x")).alias("n")).first()["n"] or 1, 1)
    # reference directions: rows by a hash of the id
    mark = F.sha2(F.col("id").cast("string"), 256)
    some = rows.where(F.exists("x", lambda c: c != 0)).orderBy(mark, "x").limit(use.references).toArrow()
    found = np.zeros((0, width))
    if some.num_rows:
        limit = score_limit(width)
        _, first = vectors.scaled(some.column("x"), use.scale, limit)
        found = vectors.unpacked(vectors.packed(first, width), width).astype(np.float64)
        norm = np.sqrt((found**2).sum(axis=1))
        found = found[norm > 0] / norm[norm > 0][:, None]
    limit = score_limit(width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ints = vectors.scaled(b.column(2), use.scale, limit)
            v = vectors.packed(ints, width)
            length, angle = lengths_and_angles(vectors.unpacked(v, width), found)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), v, pa.array(length),
                 pa.array([r.tobytes() for r in angle.astype("<f4")], pa.binary())],
                names=["id", "label", "v", "length", "angle"])

    return rows.mapInArrow(pack, "id long, label long, v binary, length double, angle binary"), width


OUT = "slot long, score long, id long, row long"


def _told(best: Best) -> Iterator[pa.RecordBatch]:
    slot, score, lost, id_, row = best.held
    yield pa.RecordBatch.from_arrays(
        [pa.array(slot), pa.array(score), pa.array(id_, mask=lost), pa.array(row)], names=["slot", "score", "id", "row"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best k of each slot over all tasks, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, anchors: Rows, width: int, use: Settings) -> DataFrame:
    """The best rows of each anchor's label, the anchor itself left out; slot is the anchor's place."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.row), use.positives)

        def wanted(here, rows, low, high):
            return ((anchors.label[here][:, None] == rows.label) & (anchors.row[here][:, None] != rows.row)
                    & (high >= best.least[here][:, None]))

        for part, a, x, score in pairs_of(anchors, batches, width, use.slack, wanted):
            best.offer(a, score, part.lost[x], part.id[x], part.row[x])
        yield from _told(best)

    return _first(rows.mapInArrow(search, OUT), use.positives)


def beneath(rows: DataFrame, anchors: Rows, floor: np.ndarray, top: np.ndarray, width: int, use: Settings) -> DataFrame:
    """The best rows of other labels in each of the anchors' score windows.

    ``floor`` and ``top`` are (anchors, windows), both ends included; slot is
    anchor * windows + window.
    """
    windows = floor.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(floor.size, use.negatives)

        def wanted(here, rows, low, high):
            meets = np.zeros(low.shape, dtype=bool)
            least = np.maximum(best.least.reshape(floor.shape), floor)[here]
            for w in range(windows):
                meets |= (high >= least[:, w, None]) & (low <= top[here][:, w, None])
            return meets & (anchors.label[here][:, None] != rows.label)

        for part, a, x, score in pairs_of(anchors, batches, width, use.slack, wanted):
            for w in range(windows):
                good = (score >= floor[a, w]) & (score <= top[a, w])
                at = x[good]
                best.offer(a[good] * windows + w, score[good], part.lost[at], part.id[at], part.row[at])
        yield from _told(best)

    return _first(rows.mapInArrow(search, OUT), use.negatives)


def mined(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: Column | None = None,
          use: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``label`` is the column to compare; the column ``label`` by default.
    """
    spark = df.sparkSession
    shelf = Shelf(spark, "negatives")
    made, width = prepared(df, id_column, vector, F.col("label") if label is None else label, use)
    rows = shelf.put(made.withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = rows.where(F.col("id") % use.every == 0)
    held = 8 * width + 4 * use.references + 64 + 48 * use.positives * (use.negatives + 1)  # bytes of an anchor and its best
    blocks = max(1, -(-asked.count() * held // use.block_bytes))
    parts = []
    for block in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select(*Rows.COLUMNS).toArrow()
        if not table.num_rows:
            continue
        anchors = Rows.of(table.combine_chunks(), width)
        found = shelf.put(nearest(rows, anchors, width, use), "positives").toArrow()  # a few rows an anchor
        slot, rank = found.column("slot").to_numpy(), found.column("rank").to_numpy() - 1
        floor = np.ones((len(anchors.row), use.positives), np.int64)
        top = np.zeros_like(floor)  # an empty window
        score = found.column("score").to_numpy()
        floor[slot, rank] = -((-use.low * score) // 100)
        top[slot, rank] = use.high * score // 100
        worst = shelf.put(beneath(rows, anchors, floor, top, width, use), "negatives")
        about = pa.table({
            "slot": slot * use.positives + rank, "anchor_id": anchors.id[slot], "positive_id": found.column("id"),
            "positive_score": found.column("score")})
        parts.append(shelf.put(worst.join(spark.createDataFrame(about), "slot").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "mined").shelf_path)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    return spark.read.parquet(*parts)
