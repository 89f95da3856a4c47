"""A toxicity score that does not move when a group's name is swapped.

Logistic regression on hashed words and word beginnings. Sentences of the
training texts that name a group are paired with the same sentence naming
another group of the same kind; the squared difference of the two scores is
part of the loss. A word that only tells who is spoken of then carries no
weight, so neutral mentions are not scored up.

The fit sees a bounded sample of labelled rows (``Settings.fit_rows``, drawn by
a hash of the key); scoring sees every whole text.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throughdoor.llm import words
from throughdoor.llm.stored import Shelf

# --- fixed values: group names by kind; a name is swapped for the next one
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"], ["she", "he"], ["her", "his"],
    ["female", "male"], ["gay", "straight", "bisexual"], ["lesbian", "heterosexual"], ["transgender", "cisgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab"], ["african", "european", "american", "mexican", "chinese", "indian"],
    ["immigrant", "native", "foreigner", "refugee"], ["immigrants", "natives", "foreigners", "refugees"],
    ["old", "young"], ["elderly", "teenage"], ["disabled", "deaf", "blind"], ["rich", "poor"],
    ["frauen", "männer"], ["frau", "mann"], ["muslime", "christen", "juden"], ["ausländer", "einheimische"],
    ["femmes", "hommes"], ["femme", "homme"], ["musulmans", "chrétiens", "juifs"], ["étrangers", "français"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["musulmanes", "cristianos", "judíos"], ["extranjeros", "españoles"],
]
SWAP = {name: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, name in enumerate(kind)}
_NAMED = re.compile(r"(?<!\w)(" + "|".join(sorted(SWAP, key=len, reverse=True)) + r")(?!\w)")
_SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class Settings:
    fit_rows: int = 8_000  # labelled rows that the fit may see
    pair_rows: int = 20_000  # swapped sentences that the fit may see, drawn by a hash
    buckets: int = 1 << 18
    beginnings: tuple = (3, 4, 5, 6, 7)  # bytes of a word's beginning that are features beside the word
    least_rows: int = 3  # rows a feature must occur in to be learnt
    swap_penalty: float = 10.0
    ridge: float = 1e-5
    steps: int = 150
    balance: float = 1.0  # 1: both labels count alike in the fit, 0: every row does
    rate: float = 0.3


def features(column: pa.Array, use: Settings) -> Iterator[tuple[words.Piece, np.ndarray, np.ndarray]]:
    """Piece by piece: feature buckets of every row, and their bounds.

    Each distinct word of a row gives itself and its beginnings.
    """
    lengths = (*use.beginnings, 1 << 40)
    for piece in words.pieces(pc.utf8_lower(column.cast(pa.string()))):
        found = words.split(piece, words.NO_LETTER)
        hashes = words.word_hashes(piece, found, *lengths)
        keep, bounds = [], [0]
        whole = hashes[-1]
        for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
            first = np.unique(whole[a:b], return_index=True)[1]
            keep.append(first + a)
            bounds.append(bounds[-1] + len(first))
        keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        salt = np.arange(1, len(lengths) + 1, dtype=np.uint64)[:, None]
        buckets = words.mix(hashes[:, keep] + salt) % np.uint64(use.buckets)
        yield piece, buckets.T.ravel().astype(np.int32), np.array(bounds) * len(lengths)


def swapped(text: str) -> str:
    return _NAMED.sub(lambda m: SWAP[m.group(1)], text)


def _training_rows(rows: DataFrame, use: Settings) -> DataFrame:
    """(label, buckets, other): texts with their label, and swapped sentences without."""
    schema = "label int, buckets binary, other binary"

    def packed(texts: list[str]) -> list[bytes]:
        out = []
        for _, flat, bounds in features(pa.array(texts, pa.string()), use):
            out += [flat[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.lower() for t in part.column(0).fill_null("").to_pylist()]
                named = [s for t in texts if _NAMED.search(t) for s in _SENTENCE.findall(t) if _NAMED.search(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([part.column(1).cast(pa.int32()), pa.nulls(len(named), pa.int32())]),
                     pa.array(packed(texts) + packed(named), pa.binary()),
                     pa.array([None] * len(texts) + packed([swapped(s) for s in named]), pa.binary())],
                    names=["label", "buckets", "other"])

    return rows.mapInArrow(run, schema)


class Sparse:
    """Rows of features, each scaled to unit length if no feature repeats.

    Worked on some rows at a time, so that no array of all features in double
    precision is ever made.
    """

    ROWS = 512

    def __init__(self, packed: list[bytes], keep: np.ndarray):
        each = [np.frombuffer(b, np.int32) for b in packed]
        self.scale = np.array([1 / np.sqrt(max(len(x), 1)) for x in each])
        each = [x[keep[x]] for x in each]
        self.rows = len(each)
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        self.flat = np.concatenate(each) if each else np.zeros(0, np.int32)

    def _parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for a in range(0, self.rows, self.ROWS):
            b = min(a + self.ROWS, self.rows)
            yield slice(a, b), self.flat[self.bounds[a]: self.bounds[b]], self.bounds[a: b + 1] - self.bounds[a]

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        for rows, flat, bounds in self._parts():
            sums = np.concatenate([[0.0], np.cumsum(w[flat])])
            out[rows] = (sums[bounds[1:]] - sums[bounds[:-1]]) * self.scale[rows]
        return out

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for rows, flat, bounds in self._parts():
            out += np.bincount(flat, weights=np.repeat(g[rows] * self.scale[rows], np.diff(bounds)), minlength=n)
        return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for piece, flat, bounds in features(column, self.settings):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[flat], dtype=np.float64)])
            z = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(np.diff(bounds), 1)) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(labels: np.ndarray, texts: list[bytes], left: list[bytes], right: list[bytes], use: Settings) -> Model:
    """Minimise log loss + penalty of score changes under swaps + ridge (Adam, all rows a step)."""
    n = use.buckets
    if len(labels) == 0:
        return Model(np.zeros(n), 0.0, use)
    seen = np.zeros(n, dtype=np.int32)
    for b in texts:
        seen[np.unique(np.frombuffer(b, np.int32))] += 1
    keep = seen >= use.least_rows
    x, one, two = (Sparse(rows, keep) for rows in (texts, left, right))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    # a rare label's rows count for more, so that 0.5 lies between the labels and not beyond one of them
    counts = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** use.balance
    counts /= counts.sum()
    share = float(counts @ labels)
    share = min(max(share, 0.5 / (len(labels) + 1)), 1 - 0.5 / (len(labels) + 1))
    bias, w = float(np.log(share / (1 - share))), np.zeros(n)
    m, v = np.zeros(n), np.zeros(n)
    for step in range(1, use.steps + 1):
        off = (1 / (1 + np.exp(-(x.times(w) + bias))) - labels) * counts
        grad = x.back(off, n) + use.ridge * w
        if one.rows:
            change = one.times(w) - two.times(w)
            grad += 2 * use.swap_penalty / one.rows * (one.back(change, n) - two.back(change, n))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= use.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-5)
        bias -= 0.1 * off.sum()
    return Model(w * keep, bias, use)


def train(rows: DataFrame, use: Settings = Settings()) -> Model:
    """Fit on ``rows`` (key, text, label 0/1), a sample of at most ``fit_rows`` of them.

    Rows are taken in the order of a hash of ``key`` up to a rate that the
    count of rows gives, so the sample is the same in every run. Null texts are
    empty; rows with a null label are left out; rows that repeat are each learnt
    from. With no rows every score is 0.5. Swapped sentences beyond
    ``pair_rows`` are left out by a hash of their features.
    """
    rows = rows.where("label IS NOT NULL")
    n = rows.count()
    part = (F.xxhash64("key") % 1_000_003 + 1_000_003) % 1_000_003
    # a little under the bound, so that the limit below is almost never the one that cuts
    rate = 1.0 if n <= use.fit_rows else 0.97 * use.fit_rows / n
    sample = rows.where(part < int(rate * 1_000_003) + 1).limit(use.fit_rows).select("text", "label")
    made = Shelf(rows.sparkSession, "toxicity").put(_training_rows(sample, use), "rows")
    labelled = made.where("label IS NOT NULL").select("label", "buckets").toArrow()
    # the pairs that a hash of them puts first, wherever they lie
    pairs = made.where("label IS NULL").select("buckets", "other").orderBy(
        F.xxhash64("buckets", "other"), "buckets", "other").limit(use.pair_rows).toArrow()
    return fit(labelled["label"].to_numpy().astype(np.float64), labelled["buckets"].to_pylist(),
               pairs["buckets"].to_pylist(), pairs["other"].to_pylist(), use)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the score of the whole text in [0, 1]; null texts score as empty."""
    names = [c for c in docs.columns if c != out]
    at = names.index(text)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.score(part.column(at)), pa.float64())], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the key as text leaves ``part`` modulo ``parts``; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, use: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, toxic) of documents that are not held out
    (crc32 of the id modulo 5 is not 0). The key picks rows; only the text is
    scored. Null and empty texts have the score of a text without words, equal
    texts the same score; rows that repeat are each answered, an empty table
    gives none, and without labels every score is 0.5. Other columns of both
    tables are not looked at.
    """
    known = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("label"))
    known = known.where(~held_out(F.col("doc_id"), 5, 0))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select(F.col("doc_id").alias("key"), "text", "label")
    model = train(rows, use)
    return score(docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
