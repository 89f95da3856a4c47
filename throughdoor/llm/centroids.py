"""Centroid clustering with integer vectors: equal-average equal-variance search.

A vector's squared distance to a centroid is at least the squared difference of
their component sums divided by the dimension, plus the squared difference of
their deviations (Euclidean lengths after the mean is taken off). Centroids
are sorted by mean; the search begins at the vector's own mean and goes
outward. It ends when the mean alone rules out what is left on both sides,
skips a centroid that mean and deviation together rule out, and takes the exact
integer distance of the others. Bounds are widened for rounding, so the result
is that of a full search.

Every round is one pass of the vectors: a task adds up its vectors by cluster
in integers, and only those sums are shuffled.

Defined results: a vector of another length, a null one, or one with a null or
non-finite component is in no cluster and has no row. Repeated rows count each
for itself, and a null id is an id like any other that starts no cluster while
others can. Of rows with the same id, the smallest vectors start clusters.
Fewer vectors than clusters: as many clusters as vectors. An empty table gives
an empty result. Columns besides id and vector are not read, so their names
cannot clash. Components of 2**30 / dims or more after scaling are refused.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throughdoor.llm import vectors
from throughdoor.llm.stored import Shelf
from throughdoor.runtime import small_table


@dataclass(frozen=True)
class Settings:
    clusters: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    salt: str = "3"  # of the hash that picks the first centroids
    table_bytes: int = 32 << 20  # of centroids and their sums, which every task holds

    def __post_init__(self):
        if 8 * self.clusters * self.dims > self.table_bytes:
            raise ValueError(f"{self.clusters} centroids of {self.dims} components exceed {self.table_bytes} bytes")


_FAR = np.int64(1) << np.int64(62)


class Ranked:
    """Centroids in the order of their means."""

    def __init__(self, centres: np.ndarray):
        total = centres.sum(axis=1)
        self.number = np.argsort(total, kind="stable")  # place in the order -> number
        self.centres, self.total = centres[self.number], total[self.number]
        self.spread = spread(self.centres, self.total)
        self.scored = 0  # exact distances taken so far

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid (ties: the smaller) and its squared distance."""
        n, dims, k = *x.shape, len(self.total)
        total = x.sum(axis=1)
        deviation = spread(x, total)
        best, who = np.full(n, _FAR), np.full(n, k)
        up = np.searchsorted(self.total, total)
        down = up - 1
        rows = np.arange(n)
        while len(rows):
            low, high, here = down[rows], up[rows], total[rows]
            below = np.where(low >= 0, here - self.total[np.maximum(low, 0)], _FAR)
            above = np.where(high < k, self.total[np.minimum(high, k - 1)] - here, _FAR)
            lower = below <= above
            gap = np.where(lower, below, above)
            by_mean = gap.astype(np.float64) ** 2 / dims
            reach = best[rows] * (1 + 1e-9) + 1
            on = (gap < _FAR) & (by_mean <= reach)  # else both sides are too far
            rows, lower, by_mean, reach = rows[on], lower[on], by_mean[on], reach[on]
            at = np.where(lower, low[on], high[on])
            down[rows[lower]] -= 1
            up[rows[~lower]] += 1
            look = by_mean + (deviation[rows] - self.spread[at]) ** 2 <= reach
            asked, at = rows[look], at[look]
            self.scored += len(asked)
            exact = ((x[asked] - self.centres[at]) ** 2).sum(axis=1)
            number = self.number[at]
            closer = (exact < best[asked]) | ((exact == best[asked]) & (number < who[asked]))
            best[asked[closer]], who[asked[closer]] = exact[closer], number[closer]
        return who, best


def spread(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows less their means; exact up to the root."""
    dims = x.shape[1]
    return np.sqrt((dims * (x * x).sum(axis=1) - total * total) / dims)


def prepared(df: DataFrame, id_column: str, vector: str, use: Settings) -> DataFrame:
    """(id, v): usable vectors as packed integers."""
    limit = (1 << 30) // use.dims  # squares of sums stay below 2**62

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = vectors.scaled(b.column(1), use.scale, limit, use.dims)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), vectors.packed(found, use.dims)], names=["id", "v"])

    kind = df.schema[id_column].dataType
    return df.select(F.col(id_column).alias("id"), F.col(vector).alias("x")).mapInArrow(
        pack, T.StructType([T.StructField("id", kind), T.StructField("v", T.BinaryType())]))


def starts(rows: DataFrame, use: Settings) -> np.ndarray:
    """The vectors of the smallest hashes, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{use.salt}:"), F.col("id").cast("string")), 256)
    first = rows.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(use.clusters)
    found = sorted(first.collect(), key=lambda r: (r["mark"] is None, r["mark"] or "", bytes(r["v"])))
    return vectors.unpacked(pa.array([bytes(r["v"]) for r in found], pa.binary()), use.dims)


def moved(rows: DataFrame, centres: np.ndarray, use: Settings) -> np.ndarray:
    """One round: assign all vectors, and floor the mean of each cluster's."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Ranked(centres)
        sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in batches:
            x = vectors.unpacked(b.column(0), use.dims)
            who, _ = ranked.nearest(x)
            order = np.argsort(who, kind="stable")
            held, at = np.unique(who[order], return_index=True)
            if len(held):
                sums[held] += np.add.reduceat(x[order], at, axis=0)
                counts += np.bincount(who, minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    part = rows.select("v").mapInArrow(add, "cluster int, n long, sums array<long>")
    total = part.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = centres.copy()
    for r in total.collect():  # clusters x dims rows, bounded by table_bytes
        out[r["cluster"], r["place"]] = r["total"] // r["n"]
    return out


def assigned(rows: DataFrame, centres: np.ndarray, use: Settings) -> DataFrame:
    """(id, cluster, distance) of all vectors."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Ranked(centres)
        for b in batches:
            who, distance = ranked.nearest(vectors.unpacked(b.column(1), use.dims))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(who.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    schema = T.StructType([rows.schema["id"], T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])
    return rows.mapInArrow(assign, schema)


def clustered(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", use: Settings = Settings()) -> DataFrame:
    """One row per usable vector: id, cluster, squared distance, and its cluster's figures."""
    spark = df.sparkSession
    shelf = Shelf(spark, "centroids")
    rows = shelf.put(prepared(df, id_column, vector, use), "vectors")
    centres = starts(rows, use)
    for _ in range(use.rounds if len(centres) else 0):
        before, centres = centres, moved(rows, centres, use)
        if (before == centres).all():  # every later round would give the same
            break
    found = shelf.put(assigned(rows, centres, use), "assigned") if len(centres) else assigned(rows.limit(0), centres, use)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    figures = [(i, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[i].tolist())).encode()).hexdigest())
               for i, s in sorted(inertia.items())]
    about = small_table(spark, figures, T.StructType([
        T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
        T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())]))
    return found.join(about, "cluster").select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
