"""Weighted means, discrimination measures and densities."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import cumulate


def weighted_mean(x: Column, w: Column) -> Column:
    """Weighted mean over rows where both are present; null without weight."""
    both = x.isNotNull() & w.isNotNull()
    total = F.sum(F.when(both, w))
    return F.when(total > 0, F.sum(F.when(both, x * w)) / total)


def effective_sample_size(w: Column) -> Column:
    """Kish effective sample size (sum w)^2 / sum w^2 over positive weights."""
    pos = F.when(w > 0, w)
    return F.coalesce(F.try_divide(F.pow(F.sum(pos), F.lit(2.0)), F.sum(pos * pos)), F.lit(0.0))


def _by_score(df, keys, score, y, w):
    df = df.where(F.col(y).isNotNull() & F.col(score).isNotNull() & (F.col(w) > 0))
    tp, fp = F.col(w) * F.col(y), F.col(w) * (F.lit(1.0) - F.col(y))
    return _running(df.select(*keys, score, tp.alias("tp"), fp.alias("fp")), keys, score)


def _running(df, keys, score):
    at = df.groupBy(*keys, score).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return cumulate(at, keys, score, ["tp", "fp"], descending=True)


def roc_points(df: DataFrame, keys, score: str, y: str, w: str) -> DataFrame:
    """ROC corners per key, higher score = worse, ties collapsed.

    With only one class present the curve is the diagonal (0,0)-(1,1).
    """
    run = _by_score(df, keys, score, y, w)
    both = (F.col("tp_all") > 0) & (F.col("fp_all") > 0)
    curve = run.where(both).select(
        *keys, F.col(score).cast("double").alias("threshold"),
        (F.col("fp_through") / F.col("fp_all")).alias("fpr"),
        (F.col("tp_through") / F.col("tp_all")).alias("tpr"))
    ends = run.groupBy(*keys).agg(F.max(both).alias("two"))
    origin = ends.select(*keys, F.explode(
        F.when(F.col("two"), F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    ).alias("fpr")).select(*keys, F.lit(None).cast("double").alias("threshold"), "fpr",
                           F.col("fpr").alias("tpr"))
    return curve.unionByName(origin)


def discrimination(df: DataFrame, keys, score: str, y: str, w: str) -> DataFrame:
    """AUC, Gini and KS per key; 0.5 / 0 / 0 when only one class is present."""
    return _areas(_by_score(df, keys, score, y, w), keys)


def discrimination_of_totals(df: DataFrame, keys, score: str) -> DataFrame:
    """As ``discrimination``, from bad and good weight (``tp``, ``fp``) per score."""
    return _areas(_running(df, keys, score), keys)


def _areas(run, keys):
    area = F.sum(F.col("fp") * (2.0 * F.col("tp_through") - F.col("tp")))
    got = run.groupBy(*keys).agg(
        area.alias("area"), F.max("tp_all").alias("P"), F.max("fp_all").alias("N"),
        F.max(F.abs(F.try_divide("tp_through", "tp_all")
                    - F.try_divide("fp_through", "fp_all"))).alias("gap"))
    two = (F.col("P") > 0) & (F.col("N") > 0)
    auc = F.when(two, F.try_divide(F.col("area"), 2.0 * F.col("P") * F.col("N"))).otherwise(0.5)
    return got.select(*keys, auc.alias("auc"), (2.0 * auc - 1.0).alias("gini"),
                      F.when(two, F.col("gap")).otherwise(0.0).alias("ks"))


def metric_bundle(df: DataFrame, keys, score: str, y: str, w: str) -> DataFrame:
    """AUC, Gini, KS, bad rate and row counts (all rows, and rows used)."""
    used = F.col(y).isNotNull() & F.col(score).isNotNull() & (F.col(w) > 0)
    rest = df.groupBy(*keys).agg(
        weighted_mean(F.col(y), F.col(w)).alias("bad_rate"),
        F.count(F.lit(1)).alias("n"), F.sum(used.cast("bigint")).alias("n_used"))
    return rest.join(discrimination(df, keys, score, y, w), list(keys), "left")


def histogram(df: DataFrame, keys, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Density over equal bins; the last bin is closed on the right."""
    width = (hi - lo) / bins
    x = F.col(value)
    at = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = (df.where(x.between(lo, hi)).withColumn("bin_no", at)
              .groupBy(*keys, "bin_no").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n_all"))
    return counts.join(totals, list(keys)).select(
        *keys, "bin_no", (F.lit(lo) + F.col("bin_no") * F.lit(width)).alias("left_edge"), "n",
        (F.col("n") / (F.col("n_all") * F.lit(width))).alias("density"))
