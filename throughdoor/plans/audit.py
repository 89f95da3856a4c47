"""The whole audit: one call from raw application tables to result tables.

    run_audit(spark, accepted_raw, declined_raw, spec, "s3://bucket/audit")

Result tables are written as CSV with a header under their own folder, the
headline numbers as JSON rows (section, metric, key, value).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NUMERIC, SCORE_WINDOW, Audit
from ..operators import backtest, binning, economics, measures, population, regions
from ..runtime import materialize
from ..sources import applications
from .frames import KEY, KEYS, Portfolio


def long_form(df: DataFrame, section: str, key: str | None = None) -> DataFrame:
    """Numeric columns of a result table as (section, metric, key, value) rows."""
    who = F.col(key).cast("string") if key else F.lit("")
    names = [c for c, t in df.dtypes if t in ("double", "bigint", "int") and c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                      for c in names])
    return df.select(F.lit(section).alias("section"), who.alias("key"), F.explode(pairs).alias("m")).select(
        "section", "m.metric", "key", "m.value")


def coverage(p: Portfolio) -> DataFrame:
    """Missing values before any fill or scored filter."""
    return population.field_coverage(
        population.terminal(applications.harmonise_accepted(p.accepted_raw, fill=False)),
        applications.harmonise_declined(p.declined_raw, fill=False))


def method_table(p: Portfolio) -> DataFrame:
    """The four methods on real declines, and the selection model with exclusion."""
    rows = p.inferred.estimates().select("method", "est_reject_bad_rate", "est_ttd_bad_rate",
                                         F.col("claimed_gini").alias("claimed_ttd_gini"))
    more = p.excluded.estimates.select(
        F.lit("heckman_with_exclusion").alias("method"), "est_reject_bad_rate", "est_ttd_bad_rate",
        F.lit(None).cast("double").alias("claimed_ttd_gini"))
    return rows.unionByName(more)


def result_tables(p: Portfolio) -> dict:
    """The sixteen result tables by name; each is computed when written."""
    spec, econ = p.spec, p.spec.cash
    chosen = p.applicants.where("method = 'heckman'")
    decline = regions.decline_model(p.stacked, KEYS, NUMERIC, spec.bins, spec.fit)
    residuals = materialize(regions.zip_residuals(
        decline.score(p.stacked, "p"), KEYS, "p", spec.regions), "residuals")
    swaps = materialize(economics.swap_economics(
        p.applicants, [KEY, "method"], p.calibration, econ, spec.seed, resampling=spec.resampling), "swaps")
    bins = p.baseline.bins
    return {
        "00_field_coverage": coverage(p),
        "01_scorecard_points": p.baseline.points_table(spec.points).orderBy("feature", "bin_no"),
        "02_woe_bins": bins.orderBy("feature", "bin_no"),
        "03_information_value": binning.iv_table(bins, KEYS).orderBy(F.desc("iv")),
        "04_real_data_methods": method_table(p),
        "05_backtest_raw": p.backtest,
        "06_backtest_summary": p.summary.orderBy("cutoff_type", "rejection_rate", "method"),
        "07_method_ranking": backtest.rank_methods(p.summary).orderBy(
            "mean_abs_bad_rate_bias", "mean_abs_gini_bias"),
        "08_null_case": backtest.null_case(p.backtest).orderBy("mean_abs_bad_rate_bias"),
        "09_rho_sweep": backtest.rho_sweep(p.backtest).orderBy("cutoff_type", "rejection_rate"),
        "10_realised_yields_by_band": economics.yields_by_band(
            p.calibration, KEYS, "pd_baseline", econ).orderBy("band"),
        "11_swap_set_economics": swaps,
        "12_zip3_residuals": residuals.orderBy(F.desc("z")),
        "13_profit_sensitivity": economics.funding_sensitivity(
            chosen, [KEY, "method"], p.calibration, econ).orderBy("cost_of_funds_annual"),
        "14_swap_in_profile": economics.swap_profile(chosen, KEYS),
        "15_scale_factor_sensitivity": p.sensitivity.orderBy(
            "cutoff_type", "method", "reject_bad_scale"),
        "16_zip3_dispersion": regions.dispersion(residuals, KEYS, spec.regions),
        "17_breaking_point": backtest.breaking_point(p.summary),
    }


def headline(p: Portfolio, tables: dict) -> DataFrame:
    """The numbers a report quotes, as one long table."""
    test = measures.metric_bundle(p.baseline.score(p.split, "pd"), ["is_test"], "pd", "bad", "w")
    pooled = economics.breakeven(economics.pooled_yields(p.calibration, KEYS, p.spec.cash),
                                 p.spec.cash)
    parts = [
        long_form(p.panel.audit, "data"),
        long_form(population.overlap_share(p.panel.accepted, p.panel.declined_all, SCORE_WINDOW), "data"),
        long_form(tables["00_field_coverage"], "coverage", "field"),
        long_form(test, "baseline", "is_test"),
        long_form(tables["03_information_value"], "information_value", "feature"),
        long_form(tables["04_real_data_methods"], "methods", "method"),
        long_form(p.inferred.views["ipw"].diagnostics, "positivity"),
        long_form(p.inferred.selection.diagnostics, "selection"),
        long_form(tables["07_method_ranking"], "ranking", "method"),
        long_form(tables["08_null_case"], "null_case", "method"),
        long_form(pooled, "yields"),
        long_form(tables["11_swap_set_economics"], "economics", "method"),
        long_form(tables["13_profit_sensitivity"], "sensitivity", "cost_of_funds_annual"),
        long_form(tables["16_zip3_dispersion"], "regions"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def run_audit(spark: SparkSession, accepted_raw: DataFrame, declined_raw: DataFrame, spec: Audit,
              out: str) -> dict:
    """Write every result table below ``out`` and return them, read back."""
    p = Portfolio(spark, lambda: accepted_raw, lambda: declined_raw, spec)
    tables = result_tables(p)
    got = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
        got[name] = spark.read.schema(df.schema).option("header", True).csv(f"{out}/{name}")
    headline(p, got).write.mode("overwrite").json(f"{out}/headline_numbers")
    got["headline_numbers"] = spark.read.schema(
        "section string, metric string, key string, value double").json(f"{out}/headline_numbers")
    return got
