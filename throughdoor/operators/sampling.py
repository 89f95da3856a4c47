"""Seeded samples and splits."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..runtime import localize

DRAW_SLICES = 65_536


def bernoulli(df: DataFrame, row_id: str, rate: float, salt: str) -> DataFrame:
    return df.where(uniform(row_id, salt) < F.lit(rate))


def split_flag(row_id: str, fraction: float, salt) -> F.Column:
    return uniform(row_id, salt) < F.lit(fraction)


def fixed_size(df: DataFrame, keys, row_id: str, size, salt) -> DataFrame:
    """The ``size`` rows of each key with the smallest draws.

    Draws are uniform, so equal slices of [0, 1) hold equal shares of a key.
    Slice counts show which slices are wholly kept; only rows of the slice that
    holds the last kept row need ranking.
    """
    size = F.col(size) if isinstance(size, str) else F.lit(size)
    drawn = df.withColumn("_u", uniform(row_id, salt))
    drawn = drawn.withColumn("_slice", F.floor(F.col("_u") * DRAW_SLICES).cast("int"))
    drawn = drawn.withColumn("_size", size.cast("bigint"))
    counts = drawn.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_size"))
    run = (Window.partitionBy(*keys).orderBy("_slice")
           .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum("_n").over(run), F.lit(0))
    cut = counts.withColumn("_before", before).where("_before < _size").groupBy(*keys).agg(
        F.max("_slice").alias("_last"), F.max("_before").alias("_before"))
    cut = localize(cut, "sample-cut")
    kept = drawn.join(cut, list(keys)).where("_slice <= _last")
    rank = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_u", row_id))
    whole = F.col("_slice") < F.col("_last")
    return (kept.withColumn("_rank", rank)
            .where(whole | (F.col("_rank") + F.col("_before") <= F.col("_size")))
            .select(*df.columns))


def capped_two_sided(df: DataFrame, keys, side: str, row_id: str, weight: str, max_rows: int,
                     min_side: int, salt) -> DataFrame:
    """Proportional subsample of both sides with re-based weights.

    Keys above ``max_rows`` keep the same fraction of either side, at least
    ``min_side`` rows of it; weights grow so each side keeps its total.
    """
    by = [*keys, side]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    total = sizes.groupBy(*keys).agg(F.sum("_rows").alias("_all"))
    share = F.lit(float(max_rows)) / F.col("_all")
    part = F.floor(F.col("_rows") * share).cast("bigint")
    keep = F.when(F.col("_all") <= max_rows, F.col("_rows")).otherwise(
        F.least(F.col("_rows"), F.greatest(part, F.lit(min_side).cast("bigint"))))
    plan = localize(sizes.join(total, list(keys)).select(*by, "_rows", keep.alias("_keep")), "caps")
    sized = df.join(plan, by)
    kept = fixed_size(sized, by, row_id, "_keep", salt)
    return kept.select(*[c for c in df.columns if c != weight],
                       (F.col(weight) * F.col("_rows") / F.col("_keep")).alias(weight))
