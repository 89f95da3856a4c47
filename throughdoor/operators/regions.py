"""Regional residuals of the decline decision, given risk alone."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NUMERIC, BinRules, FitRules, RegionRules
from ..functions.normal import chi_square_tail, normal_cdf
from . import scorecard
from .ordered import quantiles


def decline_model(stacked: DataFrame, keys, numeric=tuple(NUMERIC), spec: BinRules = BinRules(),
                  rules: FitRules = FitRules()) -> scorecard.Scorecards:
    """P(declined | risk fields), blind to geography and unweighted."""
    rows = stacked.select(*keys, *numeric, (1.0 - F.col("accepted")).alias("y"), F.lit(1.0).alias("w"))
    return scorecard.fit(rows, keys, list(numeric), [], "y", "w", spec, rules)


def zip_residuals(rows: DataFrame, keys, p: str, spec: RegionRules = RegionRules()) -> DataFrame:
    """Observed minus expected declines per ZIP prefix, standardised.

    A prefix with fewer than ``least_applications`` has its counts and rates and
    is ``small``: no excess, no ``z`` and no flag.
    """
    declined = 1.0 - F.col("accepted")
    g = rows.groupBy(*keys, "zip3").agg(
        F.count(F.lit(1)).alias("n_apps"), F.sum(declined).alias("observed_declines"),
        F.sum(p).alias("expected_declines"), F.sum(F.col(p) * (1.0 - F.col(p))).alias("var"))
    small = F.col("n_apps") < spec.least_applications
    gap = F.col("observed_declines") - F.col("expected_declines")
    return (g.withColumn("observed_rate", F.col("observed_declines") / F.col("n_apps"))
            .withColumn("expected_rate", F.col("expected_declines") / F.col("n_apps"))
            .withColumn("small", small)
            .withColumn("excess_rate_pp", F.when(~small, 100.0 * (F.col("observed_rate") - F.col("expected_rate"))))
            .withColumn("z", F.when(~small, gap / F.sqrt(F.greatest("var", F.lit(1e-9)))))
            .withColumn("flagged", F.abs("z") > spec.flag_at))


def judged(residuals: DataFrame) -> DataFrame:
    """The prefixes that are large enough for a residual."""
    return residuals.where("NOT small")


def dispersion(residuals: DataFrame, keys, spec: RegionRules = RegionRules()) -> DataFrame:
    """Is there more variation between ZIPs than risk plus noise produces?

    Small prefixes, and the applications in them, are only counted. A key with
    no other has null statistics.
    """
    z, n = F.col("z"), F.col("n_zip3")
    got = residuals.groupBy(*keys).agg(
        F.count("z").alias("n_zip3"), F.count_if("small").alias("n_zip3_small"),
        F.sum(F.when(F.col("small"), F.col("n_apps")).otherwise(0)).alias("n_apps_small"),
        F.sum(z * z).alias("chi2"), F.stddev_pop("z").alias("sd_of_z"),
        F.count_if(F.abs(z) > spec.flag_at).alias("n_flagged"),
        F.max("excess_rate_pp").alias("max_excess_decline_pp"),
        F.min("excess_rate_pp").alias("min_excess_decline_pp"))
    ends = quantiles(judged(residuals), keys, "excess_rate_pp", [0.25, 0.75])
    chance = 2.0 * normal_cdf(F.lit(-spec.flag_at)) * n
    return (got.join(ends, list(keys), "left")
            .withColumn("chi2_df", n)
            .withColumn("chi2_p", F.when(n > 0, chi_square_tail(F.col("chi2"), n.cast("int"))))
            .withColumn("dispersion_ratio", F.col("chi2") / F.nullif(n, F.lit(0)))
            .withColumn("n_flagged_expected_by_chance", chance)
            .withColumn("excess_flags", F.col("n_flagged") - chance)
            .withColumn("iqr_excess_decline_pp", F.get("q", F.lit(1)) - F.get("q", F.lit(0)))
            .drop("q"))


def top_and_bottom(residuals: DataFrame, k: int = 10) -> DataFrame:
    """The k largest and k smallest z, ties broken by ZIP prefix."""
    residuals = judged(residuals)
    top = residuals.orderBy(F.col("z").desc(), "zip3").limit(k).withColumn("end", F.lit("top"))
    low = residuals.orderBy("z", "zip3").limit(k).withColumn("end", F.lit("bottom"))
    return top.unionByName(low)


def largest_gaps(residuals: DataFrame, k: int = 15) -> DataFrame:
    return judged(residuals).orderBy(F.abs("excess_rate_pp").desc(), "zip3").limit(k)
