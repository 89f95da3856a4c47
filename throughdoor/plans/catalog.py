"""Registered queries: name -> function of (spark, data folder)."""
from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AMOUNT_WINDOW, CATEGORICAL, DTI_WINDOW, FEATURES, NUMERIC, SCORE_WINDOW, BinRules, Masking, Resampling
from ..functions import fields as R
from ..functions import normal as N
from ..operators import (backtest, binning, economics, inference, measures, ordered, policy,
                         population, regions, sampling, scorecard, selection)
from ..runtime import localize, materialize, scratch_root, small_table
from ..sources import applications
from . import audit
from .frames import KEY, KEYS, SAMPLED, WHOLE, frames, proxy_pd

QUERIES: dict = {}


def query(fn):
    """Register ``fn(Frames) -> DataFrame`` under its name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(frames(spark, sf_dir))
    return fn


def tidy(df: DataFrame, places: int = 6, **special) -> DataFrame:
    """Round doubles and widen integers, so results compare across engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "double":
            out.append(F.round(F.col(f.name), special.get(f.name, places)).alias(f.name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --- sources, sinks -----------------------------------------------------------
ACCEPTED_COLUMNS = ["app_id", "loan_amnt", "funded_amnt", "term", "int_rate", "issue_d", "loan_status",
                    "emp_length", "dti", "zip_code", "addr_state", "fico_range_low", "fico_range_high",
                    "total_rec_prncp", "total_rec_int", "recoveries"]


def _as_csv(df: DataFrame, label: str) -> str:
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("header", True).option("compression", "gzip")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("escape", '"').csv(path))
    return path


@query
def read_accepted(f):
    path = _as_csv(f.accepted_raw, "accepted-csv")
    return applications.read_accepted(f.spark, path, "app_id").select(*ACCEPTED_COLUMNS)


@query
def read_declined(f):
    named = f.declined_raw.select("app_id", *[
        F.col(target).alias(source) for source, (target, _) in applications.DECLINED_FIELDS.items()])
    return applications.read_declined(f.spark, _as_csv(named, "declined-csv"), "app_id")


@query
def cache_applicants(f):
    t = applications.cached(f.spark, "applicants", lambda: applications.harmonise_accepted(
        f.accepted_raw), WHOLE, *[f"{f.sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer", "nation")])
    return tidy(t.drop("grade", "total_pymnt"))


@query
def write_table(f):
    table = population.unscored_by_year(f.declined)
    path = f"{scratch_root(f.spark)}/table-{uuid.uuid4().hex}"
    tidy(table).write.option("header", True).csv(path)
    back = f.spark.read.schema("app_year bigint, n bigint, unscored_pct double").option("header", True)
    return back.csv(path)


@query
def data_audit(f):
    return tidy(f.panel.audit.select("n_accepted_total", "n_declined_total", "n_declined_sampled",
                                       "reject_sample_rate", "seed"))


# --- projections, filters ------------------------------------------------------
@query
def drop_footer(f):
    totals = f.accepted_raw.groupBy("loan_status").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("Total in "), "loan_status", F.lit(": "), F.col("n").cast("string")).alias("row_text"),
        F.lit(None).cast("double").alias("loan_amnt"))
    rows = f.accepted_raw.select(F.col("app_id").cast("string").alias("row_text"),
                                 F.col("loan_amnt").cast("double").alias("loan_amnt"))
    return rows.unionByName(totals).where(F.col("loan_amnt").isNotNull())


@query
def score_midpoint(f):
    return f.accepted_raw.select("app_id", R.band_midpoint("fico_range_low", "fico_range_high").alias("score"))


@query
def plausibility_window(f):
    return f.declined_raw.select(
        "app_id", R.windowed(R.number("risk_score"), SCORE_WINDOW).alias("risk_score"),
        R.windowed(R.percent("dti_ratio"), DTI_WINDOW).alias("dti"),
        R.windowed(R.number("amount_requested"), AMOUNT_WINDOW).alias("amount_requested"))


@query
def emp_length_years(f):
    padded = F.concat(F.lit(" "), F.col("emp_length"), F.lit(" "))
    return f.accepted_raw.select("app_id", "emp_length", R.employment_years(padded).alias("years"),
                                 R.employment_years("loan_status").alias("unmapped"))


@query
def percent_to_double(f):
    return f.declined_raw.select("app_id", R.percent("dti_ratio").alias("dti"),
                                 R.percent("zip_code").alias("not_a_number"))


@query
def zip_prefix(f):
    short = F.substring("zip_code", 1, 2)
    return f.accepted_raw.select("app_id", R.zip_prefix("zip_code").alias("zip3"),
                                 R.zip_prefix(short).alias("padded"))


@query
def parse_dates(f):
    issued, asked = R.month_year("issue_d"), R.iso_date("application_date")
    a = f.accepted_raw.select("app_id", issued.alias("app_date"), F.year(issued).alias("app_year"),
                              R.month_year("loan_status").alias("bad_text"))
    d = f.declined_raw.select("app_id", asked.alias("app_date"), F.year(asked).alias("app_year"),
                              R.iso_date("zip_code").alias("bad_text"))
    return tidy(a.unionByName(d))


@query
def term_months(f):
    return f.accepted_raw.select("app_id", R.leading_months("term").alias("term_months"),
                                 R.leading_months("loan_status").alias("no_digits"))


@query
def outcome_label(f):
    return f.accepted_raw.select("app_id", "loan_status", R.outcome("loan_status").alias("bad"))


@query
def sentinel_fill(f):
    return f.accepted_raw.select("app_id", R.filled("emp_length", "NA").alias("emp_length"),
                                 R.filled("addr_state", "XX").alias("state"))


@query
def terminal_only(f):
    return population.terminal(f.accepted).select("app_id", "bad")


@query
def scored_declines(f):
    return population.scored(f.declined).select("app_id", "risk_score")


# --- samples, splits -----------------------------------------------------------
@query
def bernoulli_sample(f):
    p = f.sampled
    kept = sampling.bernoulli(f.declined, "app_id", SAMPLED.sample.declined_rate,
                              f"declined_sample:{SAMPLED.seed}")
    return tidy(kept.select("app_id", F.lit(float(p.rates["w_declined"])).alias("design_w")))


@query
def fixed_size_sample(f):
    return f.sampled.accepted.select("app_id")


@query
def train_test_split(f):
    return f.split.select("app_id", "is_test")


@query
def backtest_pool(f):
    spec = Masking(pool_rows=3000)
    pool = policy.draw_pools(f.terminal.select("app_id"), spec, WHOLE.seed, spec.replicates)
    return tidy(pool.select("replicate", "app_id"))


@query
def eval_split(f):
    spec = WHOLE.masking
    pool = policy.draw_pools(f.terminal.select("app_id"), spec, WHOLE.seed, spec.replicates)
    return tidy(pool.select("replicate", "app_id", "is_eval"))


@query
def capped_subsample(f):
    rows = f.stacked.select(KEY, "app_id", F.col("accepted").cast("bigint").alias("accepted"), "design_w")
    got = sampling.capped_two_sided(rows, KEYS, "accepted", "app_id", "design_w", 5000, 100, "cap:1")
    return tidy(got.select("app_id", "accepted", "design_w"))


# --- unions, grids -------------------------------------------------------------
@query
def stack_population(f):
    return tidy(f.stacked.drop(KEY))


# --- lookups, aggregates -------------------------------------------------------
@query
def interval_lookup(f):
    rows = f.terminal.withColumn(KEY, F.lit("all")).select(KEY, "app_id", "dti")
    edges = localize(ordered.quantiles(rows, KEYS, "dti", [0.1, 0.25, 0.5, 0.75, 0.9], name="edges"), "edges")
    got = rows.join(edges, KEYS).where("dti IS NOT NULL")
    return tidy(got.select("app_id", "dti", binning.bin_index("dti", "edges", 6).alias("band")))


@query
def field_coverage(f):
    return audit.coverage(f)


@query
def unscored_by_year(f):
    return tidy(population.unscored_by_year(f.declined))


@query
def panel_rates(f):
    return tidy(f.panel.audit)


@query
def weighted_mean(f):
    return tidy(f.proxy_accepted.groupBy("state").agg(
        measures.weighted_mean(F.col("dti"), F.col("w")).alias("dti"),
        measures.weighted_mean(F.col("bad"), F.col("w")).alias("bad_rate")))


@query
def effective_sample_size(f):
    return tidy(f.proxy_accepted.groupBy("state").agg(
        measures.effective_sample_size(F.col("w")).alias("ess"), F.count(F.lit(1)).alias("n")))


@query
def linear_quantiles(f):
    rows = f.terminal.select("accepted", "dti", "risk_score", "amount_requested")
    probs = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    parts = None
    for name in ("dti", "risk_score", "amount_requested"):
        q = ordered.quantiles(rows, ["accepted"], name, probs)
        pairs = F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("p"), F.col("q").alias("v")))
        one = q.select(F.lit(name).alias("field"), pairs.alias("t")).select("field", "t.p", "t.v")
        parts = one if parts is None else parts.unionByName(one)
    return tidy(parts)


@query
def overlap_share(f):
    return tidy(population.overlap_share(f.panel.accepted, f.panel.declined_all, SCORE_WINDOW).drop(KEY))


@query
def density_histogram(f):
    both = f.stacked.select(F.col("accepted").cast("bigint").alias("accepted"), "risk_score", "dti")
    score = measures.histogram(both, ["accepted"], "risk_score", 300.0, 900.0, 60)
    dti = measures.histogram(both, ["accepted"], "dti", 0.0, 100.0, 50)
    return tidy(score.withColumn("field", F.lit("risk_score")).unionByName(
        dti.withColumn("field", F.lit("dti"))))


@query
def decision_correlation(f):
    return tidy(f.proxy_applicants.groupBy("method").agg(
        F.corr(F.col("pd"), 1.0 - F.col("accepted")).alias("corr")))


# --- ordered measures ------------------------------------------------------------
@query
def roc_curve(f):
    rows = f.proxy_accepted.withColumn("one", F.lit(1.0))
    return tidy(measures.roc_points(rows, KEYS, "pd", "bad", "one").drop(KEY))


@query
def auc_gini_ks(f):
    return tidy(measures.discrimination(f.proxy_accepted, ["state"], "pd", "bad", "w"))


@query
def metric_bundle(f):
    return tidy(measures.metric_bundle(f.proxy_accepted, ["app_year"], "pd", "bad", "w"))


@query
def weighted_quantile(f):
    share = F.when(F.col("accepted") == 1, F.col("design_w")).otherwise(F.lit(0.0))
    return tidy(ordered.weighted_quantile(f.proxy_applicants, ["method"], "pd", "design_w", "app_id",
                                          share, "cutoff"))


# --- weight of evidence ------------------------------------------------------------
def _numeric_hist(f):
    rows = f.split.withColumn("bad", F.col("bad").cast("double"))
    return materialize(binning.value_histogram(rows, KEYS, NUMERIC, "bad", "w"), "values")


@query
def woe_prebins(f):
    pre = binning.pre_bins(_numeric_hist(f), KEYS, BinRules())
    return tidy(pre.select("feature", "bin_no", "sw", "swy"))


@query
def woe_numeric(f):
    bins = binning.numeric_bins(_numeric_hist(f), KEYS, BinRules())
    return tidy(bins.select("feature", "bin_no", "lo", "hi", "is_missing", "n", "bad"))


@query
def woe_iv(f):
    bins = binning.weigh(binning.numeric_bins(_numeric_hist(f), KEYS, BinRules()), KEYS, BinRules())
    return tidy(bins.select("feature", "bin_no", "bad_rate", "woe", "iv"))


@query
def woe_categorical(f):
    bins = binning.category_bins(f.split, KEYS, "state", "bad", "w", BinRules(rare_share=0.035))
    return tidy(binning.weigh(bins, KEYS, BinRules()).select(
        "feature", "label", "n", "bad", "good", "bad_rate", "woe", "iv"))


@query
def woe_transform(f):
    coded = binning.encode(f.stacked, f.baseline.bins, KEYS, NUMERIC, CATEGORICAL)
    return tidy(coded.select("app_id", *[f"{c}__woe" for c in FEATURES]))


@query
def bin_table(f):
    return tidy(f.baseline.bins.select("feature", "kind", "bin_no", "lo", "hi", "category", "is_missing",
                                       "n", "bad", "good", "bad_rate", "woe", "iv"))


@query
def iv_table(f):
    return tidy(binning.iv_table(f.baseline.bins, KEYS).drop(KEY))


# --- scorecard ------------------------------------------------------------------
@query
def scorecard_fit(f):
    return tidy(f.baseline.terms().drop(KEY))


@query
def logit_1var(f):
    card = scorecard.fit(f.split, KEYS, [], ["state"], "bad", "w", WHOLE.bins, WHOLE.fit)
    return tidy(card.terms().drop(KEY))


@query
def score_pd(f):
    got = f.baseline.score(f.stacked, "pd", keep=["app_id"], logit="log_odds")
    return tidy(got.select("app_id", "pd", "log_odds"))


@query
def points_scale(f):
    got = f.proxy_accepted.select("app_id", F.ln(F.col("pd") / (1.0 - F.col("pd"))).alias("lo"))
    return tidy(got.select("app_id", scorecard.points(F.col("lo"), WHOLE.points).alias("points")))


@query
def points_table(f):
    return tidy(f.baseline.points_table(WHOLE.points).select(
        "feature", "bin_no", "n", "bad_rate", "woe", "coef", "points"))


@query
def coef_table(f):
    return tidy(f.baseline.coef_table().drop(KEY))


@query
def evaluate_split(f):
    got = f.baseline.score(f.split, "pd")
    return tidy(measures.metric_bundle(got, ["is_test"], "pd", "bad", "w"))


# --- reject inference -------------------------------------------------------------
def _estimates(f, name):
    est = f.inferred.estimates().where(F.col("method") == name).drop(KEY)
    return tidy(est.join(f.inferred.views[name].diagnostics.withColumn("method", F.lit(name)).drop(KEY),
                         "method"))


@query
def parcelling(f):
    return _estimates(f, "parcelling").drop("band_rates")


@query
def parcel_bands(f):
    return tidy(inference.score_bands(f.context).select("band", "n", "band_rate"))


@query
def fuzzy_augment(f):
    return _estimates(f, "fuzzy")


@query
def fuzzy_rows(f):
    rows = inference.fuzzy(f.context).rows
    return tidy(rows.groupBy("state", "bad").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")))


@query
def ipw(f):
    return _estimates(f, "ipw")


@query
def ipw_weights(f):
    rows = f.proxy_accepted.withColumn("approval", 1.0 - F.col("pd"))
    got = inference.inverse_weights(rows, KEYS, "approval", WHOLE.labelling)
    return tidy(got.select("app_id", "raw_w", "cap", F.col("w").alias("weight")))


@query
def selection_model(f):
    chosen = f.inferred.selection
    return tidy(chosen.diagnostics.join(chosen.estimates, KEYS).drop(KEY), places=4)


@query
def selection_llk(f):
    """Log-likelihood at fixed parameters over all applicants."""
    x, z = (F.coalesce("risk_score", F.lit(600.0)) - 650.0) / 100.0, F.coalesce("dti", F.lit(40.0)) / 50.0
    rows = f.stacked.select(
        F.col("accepted").cast("double").alias("s"), F.coalesce("bad", F.lit(0.0)).alias("y"), "design_w",
        (F.lit(0.4) + 0.9 * x - 0.3 * z).alias("h"), (F.lit(-1.1) - 0.6 * x + 0.2 * z).alias("v"))
    cell = rows.groupBy("s", "y", "h", "v").agg(F.sum("design_w").alias("w"))
    ll = selection.loglik_column(F.col("h"), F.col("v"), F.col("s"), F.col("y"), F.lit(0.3))
    return tidy(cell.groupBy(F.col("s").cast("bigint").alias("accepted")).agg(
        F.sum(F.col("w") * ll).alias("loglik"), F.sum("w").alias("weight")), places=4)


@query
def selection_exclusion(f):
    return tidy(f.excluded.diagnostics.join(f.excluded.estimates, KEYS).drop(KEY), places=4)


@query
def claimed_gini(f):
    est = f.inferred.estimates().select("method", "claimed_gini", "claimed_ks")
    base = measures.discrimination(f.baseline.score(f.split.where("is_test"), "pd"), KEYS, "pd", "bad", "w")
    ref = base.first()["gini"]
    return tidy(est.withColumn("gini_vs_baseline_reported", F.col("claimed_gini") - F.lit(ref)))


@query
def method_table(f):
    return tidy(audit.method_table(f))


@query
def positivity(f):
    return tidy(f.inferred.views["ipw"].diagnostics.select(
        "propensity_auc", "min_propensity_accepted", "ess_ratio", "frac_weights_capped"))


# --- masked-outcome backtest --------------------------------------------------------
def _masked(f, cutoff):
    grid = policy.scenario_grid(WHOLE.masking, cutoffs=[cutoff])
    pool = policy.draw_pools(f.terminal.select("app_id", "risk_score", "bad"), WHOLE.masking, WHOLE.seed,
                             WHOLE.masking.replicates)
    got = policy.apply_policies(pool, grid, WHOLE.masking, WHOLE.seed)
    return tidy(got.groupBy("cutoff_type", "rejection_rate", "replicate").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("accepted_here")).cast("bigint")).alias("n_declined"),
        F.sum(F.when(~F.col("accepted_here"), F.col("app_id"))).alias("declined_ids"),
        F.avg(F.when(F.col("accepted_here"), F.col("bad"))).alias("accepted_bad_rate")))


@query
def mask_random(f):
    return _masked(f, "random")


@query
def mask_hard(f):
    return _masked(f, "risk_hard")


@query
def mask_soft(f):
    return _masked(f, "risk_soft")


@query
def backtest_truth(f):
    m = backtest.mask(f.terminal, WHOLE, policy.scenario_grid(WHOLE.masking))
    return tidy(m.all_facts().drop("scenario"))


def _labelling(f):
    """Backtest rows of the methods that label rows, and of no correction."""
    return f.backtest.where("method <> 'heckman'").drop("rho", "se_rho", "lr_p")


def _labelling_summary(f):
    return f.summary.where("method <> 'heckman'")


@query
def backtest_rows(f):
    return tidy(_labelling(f).drop("scenario"))


@query
def backtest_selection_rows(f):
    return tidy(f.backtest.where("method = 'heckman'").drop("scenario"))


@query
def backtest_summary(f):
    return tidy(_labelling_summary(f))


@query
def backtest_summary_all(f):
    return tidy(f.summary)


@query
def method_ranking(f):
    return tidy(backtest.rank_methods(_labelling_summary(f)))


@query
def method_ranking_all(f):
    return tidy(backtest.rank_methods(f.summary))


@query
def null_case(f):
    return tidy(backtest.null_case(_labelling(f)))


@query
def null_case_all(f):
    return tidy(backtest.null_case(f.backtest))


@query
def breaking_point(f):
    return backtest.breaking_point(_labelling_summary(f))


@query
def breaking_point_all(f):
    return backtest.breaking_point(f.summary)


@query
def holds_up_to(f):
    return backtest.holds_up_to(_labelling_summary(f))


@query
def rho_sweep(f):
    return tidy(backtest.rho_sweep(f.backtest))


@query
def scale_sensitivity(f):
    return tidy(f.sensitivity)


@query
def best_scale(f):
    return tidy(backtest.best_scale(f.sensitivity))


# --- economics ----------------------------------------------------------------------
@query
def loan_returns(f):
    return tidy(economics.loan_returns(f.terminal).select("app_id", "net", "lgd"))


@query
def yields_by_band(f):
    return tidy(economics.yields_by_band(f.proxy_calibration, KEYS, "pd_baseline", WHOLE.cash).drop(KEY))


@query
def swap_set(f):
    got = economics.swap_set(f.proxy_applicants, ["method"])
    return tidy(got.select("method", "app_id", "swap", "cutoff"))


def _valued(f):
    spec = WHOLE.cash
    bands = localize(economics.yields_by_band(f.proxy_calibration, KEYS, "pd_baseline", spec), "yields")
    pooled = localize(economics.pooled_yields(f.proxy_calibration, KEYS, spec), "pooled")
    rows = economics.with_bands(f.proxy_applicants, [KEY, "method"], f.proxy_calibration, "pd_baseline", spec)
    mid = economics.median_amount(f.proxy_applicants, [KEY, "method"])
    rows = rows.join(mid, [KEY, "method"]).withColumn(
        "amount", F.coalesce("amount_requested", "median_amount"))
    return economics.expected_profit(rows, KEYS, bands, pooled, spec)


@query
def expected_profit(f):
    return tidy(_valued(f).select("method", "app_id", "band", "profit"), places=4)


@query
def breakeven(f):
    pooled = economics.pooled_yields(f.proxy_calibration, KEYS, WHOLE.cash)
    return tidy(economics.breakeven(pooled, WHOLE.cash).drop(KEY))


MONEY = dict(profit_forgone_population=2, profit_avoided_population=2, profit_forgone_ci_lo=2,
             profit_forgone_ci_hi=2, profit_per_swap_in_applicant=4, swap_in_mean_amount=4)


@query
def swap_economics(f):
    got = economics.swap_economics(f.proxy_applicants, [KEY, "method"], f.proxy_calibration,
                                   WHOLE.cash, WHOLE.seed)
    return tidy(got.drop(KEY), **MONEY)


@query
def swap_economics_calibration_bands(f):
    """Applicants in the bands of the yields table, instead of bands of their own."""
    cash = replace(WHOLE.cash, bands_from="calibration")
    got = economics.swap_economics(f.proxy_applicants, [KEY, "method"], f.proxy_calibration, cash, WHOLE.seed,
                                   resampling=None)
    return tidy(got.drop(KEY), **MONEY)


@query
def method_economics(f):
    """Swap-set economics of the four methods on the fitted scores."""
    got = economics.swap_economics(f.applicants, [KEY, "method"], f.calibration, WHOLE.cash, WHOLE.seed)
    return tidy(got.drop(KEY), **MONEY)


@query
def bootstrap_total(f):
    rows = f.proxy_calibration.withColumn("x", F.col("amount_requested") * F.col("design_w")).where(
        "x IS NOT NULL")
    return tidy(economics.bootstrap(rows, KEYS, "x", Resampling(), WHOLE.seed).drop(KEY), places=2)


@query
def swap_profile(f):
    return tidy(economics.swap_profile(f.proxy_applicants, ["method"]))


@query
def method_swap_profile(f):
    """Swap profile under the selection model's scores."""
    return tidy(economics.swap_profile(f.applicants.where("method = 'heckman'"), KEYS).drop(KEY))


@query
def funding_sensitivity(f):
    got = economics.funding_sensitivity(f.proxy_applicants, [KEY, "method"], f.proxy_calibration,
                                        WHOLE.cash)
    return tidy(got.drop(KEY), **MONEY)


@query
def profit_range(f):
    came = economics.swap_economics(f.proxy_applicants, [KEY, "method"], f.proxy_calibration,
                                    WHOLE.cash, WHOLE.seed, resampling=None)
    return tidy(economics.profit_range(came), places=2)


# --- regions --------------------------------------------------------------------------
@query
def decline_model(f):
    return tidy(regions.decline_model(f.stacked, KEYS, spec=WHOLE.bins, rules=WHOLE.fit)
                .terms().drop(KEY))


def _residuals(f):
    rows = f.stacked.withColumn("p", proxy_pd())
    return regions.zip_residuals(rows, KEYS, "p", WHOLE.regions)


@query
def zip_residuals(f):
    return tidy(_residuals(f).drop(KEY))


@query
def zip_dispersion(f):
    got = regions.dispersion(materialize(_residuals(f), "residuals"), KEYS, WHOLE.regions)
    return tidy(got.where("n_zip3 > 0").drop(KEY))


@query
def zip_top_k(f):
    res = materialize(_residuals(f), "residuals")
    return tidy(regions.top_and_bottom(res).select("end", "zip3", "z"))


@query
def zip_largest_gaps(f):
    res = materialize(_residuals(f), "residuals")
    return tidy(regions.largest_gaps(res).select("zip3", "excess_rate_pp"))


@query
def model_zip_residuals(f):
    """Residuals and flags under the fitted risk-only decline model."""
    card = regions.decline_model(f.stacked, KEYS, spec=WHOLE.bins, rules=WHOLE.fit)
    return tidy(regions.zip_residuals(card.score(f.stacked, "p"), KEYS, "p", WHOLE.regions).drop(KEY))


@query
def z_histogram(f):
    """Density of z in 50 bins between the smallest and largest residual."""
    res = regions.judged(materialize(_residuals(f), "residuals"))
    ends = res.agg(F.coalesce(F.min("z"), F.lit(0.0)).alias("lo"),
                   F.coalesce(F.max("z"), F.lit(1.0)).alias("hi")).first()
    return tidy(measures.histogram(res, KEYS, "z", ends["lo"], ends["hi"], 50).drop(KEY))


# --- the headline document ------------------------------------------------------
@query
def headline_metrics(f):
    """All fourteen sections, each written by itself; ranking and null case are those of the labelling methods."""
    funding = funding_sensitivity(f)
    cost = F.concat_ws(" ", "method", F.col("cost_of_funds_annual").cast("string"))
    parts = [
        audit.long_form(panel_rates(f), "data"),
        audit.long_form(overlap_share(f), "data"),
        audit.long_form(tidy(audit.coverage(f)), "coverage", "field"),
        audit.long_form(evaluate_split(f), "baseline", "is_test"),
        audit.long_form(iv_table(f), "information_value", "feature"),
        audit.long_form(method_table(f), "methods", "method"),
        audit.long_form(positivity(f), "positivity"),
        audit.long_form(selection_model(f), "selection"),
        audit.long_form(method_ranking(f), "ranking", "method"),
        audit.long_form(null_case(f), "null_case", "method"),
        audit.long_form(breakeven(f), "yields"),
        audit.long_form(method_economics(f), "economics", "method"),
        audit.long_form(funding.withColumn("key", cost).drop("cost_of_funds_annual"), "sensitivity", "key"),
        audit.long_form(zip_dispersion(f), "regions"),
    ]
    path = f"{scratch_root(f.spark)}/headline-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").json(path)
    return f.spark.read.schema("section string, metric string, key string, value double").json(path)
