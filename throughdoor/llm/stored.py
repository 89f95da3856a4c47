"""Intermediate tables in the shared folder, and connected components on them."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from throughdoor.llm.words import trim
from throughdoor.runtime import scratch_root


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Batches for Python tasks of 8 MB at most (Spark: 64), unless the session has set a size."""
    if spark.conf.get(BATCH) in ("67108864b", "64MB"):
        spark.conf.set(BATCH, "8m")


class Shelf:
    """The written tables of one job, in one folder of the shared storage.

    Each table is read back with its schema, so lineage ends at files that
    outlive an executor and the planner sees their true size. ``clear`` empties
    the ones a later step no longer reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        bounded(spark)
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str, **metrics: Column):
        """Write and reread ``df``; with ``metrics``, also return their values."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        seen = Observation() if metrics else None
        told = df.observe(seen, *[m.alias(k) for k, m in metrics.items()]) if metrics else df
        # every running task holds a row group in memory
        told.write.option("parquet.block.size", 16 << 20).parquet(path)
        trim()  # the driver's own fetches and closures are done with
        back = self.spark.read.schema(df.schema).parquet(path)
        back.shelf_path = path
        return (back, seen.get) if metrics else back

    def only(self, df: DataFrame, key: str, ids: DataFrame, bound: int = 16 << 20) -> DataFrame:
        """The rows of ``df`` whose ``key`` is in ``ids`` (a written table of one long column).

        The ids are sent to every task if, by their count, they take at most
        ``bound`` bytes; a longer list is joined by a shuffle.
        """
        name = ids.columns[0]
        if 8 * ids.count() <= bound:
            ids = F.broadcast(ids)
        return df.join(ids, df[key] == ids[name], "left_semi")

    def clear(self, *tables: DataFrame) -> None:
        """Overwrite tables that nothing reads any more with empty ones."""
        for df in tables:
            self.spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(df.shelf_path)


def components(shelf: Shelf, links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``links``.

    Alternates the large-star and small-star steps: every node passes the
    smallest neighbour it knows to its larger neighbours, then to its smaller
    ones, until no edge changes. A hub's edges are joined with the hub's
    minimum (a combined aggregate), never gathered. Only nodes with a link are
    returned.
    """
    u, v, least = F.col("u"), F.col("v"), F.col("least")
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    print_of = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, state = shelf.put(start, "edges", **print_of)
    for _ in range(rounds):
        both = edges.union(edges.select(v, u))
        low = both.groupBy("u").agg(F.least(F.min("v"), u).alias("least"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), least.alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(low, "u")
        small = small.where(v > least).select(v.alias("u"), least.alias("v")).union(
            low.select(u, least.alias("v"))).distinct()
        edges, now = shelf.put(small, "edges", **print_of)
        if now == state:
            # every node now hangs on its component's smallest
            tops = edges.select(v.alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(u.alias("node"), v.alias("component")).union(tops)
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
