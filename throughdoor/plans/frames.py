"""Inputs shared by the registered queries, derived from the given tables."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORICAL, NUMERIC, Audit, Masking, RegionRules, Sampling
from ..operators import backtest, inference, population, sampling, scorecard
from ..runtime import localize, materialize, prepare
from ..sources import applications, warehouse

KEY = population.KEY
KEYS = [KEY]

# whole tables, as by default; only the size guards are lowered for small inputs
WHOLE = Audit(masking=Masking(fit_approved=200, fit_declined=50), regions=RegionRules(least_applications=100))
# the sampling operators
SAMPLED = Audit(sample=Sampling(declined_rate=0.5, accepted_rows=4000))


def proxy_pd(score: str = "risk_score"):
    """A stand-in PD that falls with the bureau score, for operators on a given score."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp((F.col(score) - 600.0) / 40.0))


def proxy_corrected():
    """A second stand-in PD that also looks at debt and amount."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(
        (F.col("risk_score") - 2.0 * F.coalesce("dti", F.lit(40.0))
         + F.coalesce("amount_requested", F.lit(20000.0)) / 500.0 - 500.0) / 40.0))


class Portfolio:
    """Every stage of one portfolio's audit, computed when first asked for.

    Shared stages are written once, so tables that build on them do not
    compute them again.
    """

    def __init__(self, spark: SparkSession, accepted_raw, declined_raw, spec: Audit):
        prepare(spark)
        self.spark, self.spec = spark, spec
        self._accepted, self._declined = accepted_raw, declined_raw

    @cached_property
    def accepted_raw(self) -> DataFrame:
        return materialize(self._accepted(), "accepted-raw")

    @cached_property
    def declined_raw(self) -> DataFrame:
        return materialize(self._declined(), "declined-raw")

    @cached_property
    def accepted(self) -> DataFrame:
        return materialize(applications.harmonise_accepted(self.accepted_raw), "accepted")

    @cached_property
    def declined(self) -> DataFrame:
        return materialize(applications.harmonise_declined(self.declined_raw), "declined")

    @cached_property
    def panel(self) -> population.Panel:
        return population.build_panel(self.accepted, self.declined, self.spec)

    @cached_property
    def terminal(self) -> DataFrame:
        return population.terminal(self.accepted)

    @cached_property
    def stacked(self) -> DataFrame:
        return materialize(population.stack(self.panel), "stacked")

    @cached_property
    def split(self) -> DataFrame:
        """Accepted rows with the train/test flag."""
        test = sampling.split_flag("app_id", self.spec.fit.test_share, f"split:{self.spec.seed}")
        return materialize(self.panel.accepted.withColumn("is_test", test)
                           .withColumn("w", F.lit(1.0)), "split")

    @cached_property
    def baseline(self) -> scorecard.Scorecards:
        return scorecard.fit(self.split.where("NOT is_test"), KEYS, NUMERIC, CATEGORICAL, "bad", "w",
                             self.spec.bins, self.spec.fit)

    @cached_property
    def context(self) -> inference.Context:
        ctx = inference.Context(self.panel.accepted, self.panel.declined, self.baseline, KEYS, self.spec)
        ctx.propensity = inference.propensity_card(ctx)
        return ctx

    @cached_property
    def inferred(self) -> inference.Inferred:
        return inference.infer(self.context)

    @cached_property
    def excluded(self) -> inference.SelectionResult:
        return inference.with_exclusion(self.context)

    @cached_property
    def applicants(self) -> DataFrame:
        """All applicants with the baseline PD and each method's PD."""
        both = self.baseline.score(self.stacked, "pd_baseline")
        return materialize(self.inferred.score(both), "applicants")

    @cached_property
    def calibration(self) -> DataFrame:
        return materialize(self.baseline.score(self.panel.accepted, "pd_baseline"), "calibration")

    @cached_property
    def backtest(self) -> DataFrame:
        return backtest.run(self.terminal, self.spec)

    @cached_property
    def summary(self) -> DataFrame:
        return localize(backtest.summarise(self.backtest), "summary")

    @cached_property
    def sensitivity(self) -> DataFrame:
        return localize(backtest.scale_sensitivity(self.terminal, self.spec), "sensitivity")


class Frames(Portfolio):
    """The portfolio derived from a data folder, and inputs for single operators."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, lambda: warehouse.accepted_raw(spark, sf_dir),
                         lambda: warehouse.declined_raw(spark, sf_dir), WHOLE)
        self.sf_dir = sf_dir

    @cached_property
    def sampled(self) -> population.Panel:
        return population.build_panel(self.accepted, self.declined, SAMPLED)

    @cached_property
    def proxy_accepted(self) -> DataFrame:
        """Terminal accepted rows with a stand-in PD and the amount as weight."""
        return (self.terminal.withColumn(KEY, F.lit("all")).withColumn("pd", proxy_pd())
                .withColumn("w", F.col("amount_requested")).withColumn("design_w", F.lit(1.0)))

    @cached_property
    def proxy_applicants(self) -> DataFrame:
        """Everyone through the door with two stand-in PDs, by method."""
        base = self.stacked.withColumn("pd_baseline", proxy_pd())
        one = base.select("*", F.lit("steep").alias("method"), proxy_corrected().alias("pd"))
        two = base.select("*", F.lit("mixed").alias("method"),
                          (0.5 * proxy_corrected() + 0.5 * proxy_pd()).alias("pd"))
        return materialize(one.unionByName(two), "proxy-applicants")

    @cached_property
    def proxy_calibration(self) -> DataFrame:
        return materialize(self.panel.accepted.withColumn("pd_baseline", proxy_pd()), "proxy-calibration")


_FRAMES: dict = {}


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FRAMES:
        _FRAMES[key] = Frames(spark, sf_dir)
    return _FRAMES[key]
