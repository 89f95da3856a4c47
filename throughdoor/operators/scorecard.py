"""Points scorecards: binning, weighted logistic fit, scaling, reports."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BinRules, FitRules, PointRules
from ..runtime import localize, materialize
from . import binning, glm


def settled(pd):
    """Scores to twelve places, so that equal scores tie however they were summed."""
    return F.rint(pd * F.lit(1e12)) / F.lit(1e12)


def probability(eta):
    return settled(F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))


@dataclass
class Scorecards:
    """Fitted scorecards of all keys: bins, coefficients, one lookup row each."""

    keys: list
    numeric: list
    categorical: list
    bins: DataFrame
    coefs: DataFrame
    lookup: DataFrame
    max_bins: int
    cells: DataFrame  # training weight and bad weight per design vector

    @property
    def features(self):
        return self.numeric + self.categorical

    def where(self, key: str, value: str) -> "Scorecards":
        """The scorecards of one value of a key, without that key."""
        rest = [k for k in self.keys if k != key]

        def only(df):
            return df.where(F.col(key) == value).drop(key)

        return Scorecards(rest, self.numeric, self.categorical, only(self.bins), only(self.coefs),
                          only(self.lookup), self.max_bins, only(self.cells))

    def training_scores(self) -> DataFrame:
        """(keys, pd, tp, fp): training weight of bads and goods per design."""
        return self._judged(self.cells)

    def _judged(self, cells: DataFrame) -> DataFrame:
        eta = F.get("beta", F.lit(0))
        for i, f in enumerate(self.features, 1):
            eta = eta + F.get("beta", F.lit(i)) * F.col(f"{f}__woe")
        return cells.join(self.coefs, self.keys).select(
            *self.keys, probability(eta).alias("pd"),
            F.col("swy").alias("tp"), (F.col("sw") - F.col("swy")).alias("fp"))

    def scores_of(self, rows: DataFrame, counts, places: DataFrame | None = None) -> DataFrame:
        """(keys, pd, tp, fp) of rows counted in variants, scored by design vector.

        ``places`` (some keys, columns of the rows) says which keys a row belongs to.
        """
        look = self.lookup if places is None else self.lookup.join(
            places, [k for k in self.keys if k in places.columns])
        return self._judged(binning.designs(rows, self.keys, look, self.numeric, self.categorical, counts))

    def score(self, rows: DataFrame, pd_name: str = "pd", keep=None, logit: str | None = None):
        """Rows with P(bad); rows may lack some keys and then fan out over them."""
        on = [k for k in self.keys if k in rows.columns]
        extra = [k for k in self.keys if k not in on]
        woes = binning.woe_columns(self.numeric, self.categorical, self.max_bins, "__own")
        keep = rows.columns if keep is None else keep
        got = rows.join(self.lookup, on).select(
            *[rows[c] for c in keep], *extra, F.col("beta").alias("_beta"), *woes)
        eta = F.get("_beta", F.lit(0))
        for i, f in enumerate(self.features, 1):
            eta = eta + F.get("_beta", F.lit(i)) * F.col(f"{f}__own")
        got = got.select(*keep, *extra, eta.alias("_eta"))
        out = [F.col(c) for c in keep + extra]
        if logit:
            out.append(F.col("_eta").alias(logit))
        return got.select(*out, probability(F.col("_eta")).alias(pd_name))

    def terms(self) -> DataFrame:
        names = F.array(*[F.lit(x) for x in ["intercept", *self.features]])
        pairs = F.explode(F.arrays_zip(names.alias("term"), F.col("beta").alias("coef"))).alias("t")
        return self.coefs.select(*self.keys, pairs).select(*self.keys, "t.term", "t.coef")

    def coef_table(self) -> DataFrame:
        iv = binning.iv_table(self.bins, self.keys).select(*self.keys, "feature", "iv")
        return (self.terms().where("term <> 'intercept'").withColumnRenamed("term", "feature")
                .join(iv, [*self.keys, "feature"]))

    def points_table(self, scaling: PointRules = PointRules()) -> DataFrame:
        """Points of each bin; a row's bins add up to its score."""
        factor, offset = points_scale(scaling)
        n = float(len(self.features))
        base = self.coefs.select(*self.keys, F.get("beta", F.lit(0)).alias("b0"))
        coef = self.terms().withColumnRenamed("term", "feature")
        points = F.lit(offset / n) + F.lit(factor) * (-F.col("b0") / n - F.col("coef") * F.col("woe"))
        return (self.bins.join(coef, [*self.keys, "feature"]).join(base, list(self.keys))
                .select(*self.keys, "feature", F.col("label").alias("bin"), "bin_no", "n",
                        "bad_rate", "woe", "coef", points.alias("points")))


def points_scale(scaling: PointRules = PointRules()) -> tuple[float, float]:
    factor = scaling.doubling / math.log(2.0)
    return factor, scaling.anchor - factor * math.log(scaling.anchor_odds)


def points(log_odds_bad, scaling: PointRules = PointRules()):
    factor, offset = points_scale(scaling)
    return F.lit(offset) - F.lit(factor) * log_odds_bad


def fit(rows: DataFrame, keys, numeric, categorical, y: str = "bad", w: str = "w",
        spec: BinRules = BinRules(), rules: FitRules = FitRules()) -> Scorecards:
    """Fit one scorecard per key on rows with a known outcome and weight."""
    used = rows.where(F.col(y).isNotNull() & (F.col(w) > 0))
    return fit_variants(used, keys, keys, numeric, categorical, [binning.Variant.plain(y, w)], spec, rules)


def fit_variants(rows: DataFrame, by, keys, numeric, categorical, variants, spec: BinRules = BinRules(),
                 rules: FitRules = FitRules(), only: DataFrame | None = None) -> Scorecards:
    """Fit one scorecard per key and variant; rows are scanned twice, whatever the variants.

    Arguments as in ``binning.variant_bins``.
    """
    bins = binning.variant_bins(rows, by, keys, numeric, categorical, variants, spec, only)
    return fit_bins(bins, keys, numeric, categorical, spec, rules,
                    lambda look: binning.designs(rows, keys, look, numeric, categorical, variants))


def fit_bins(bins: DataFrame, keys, numeric, categorical, spec: BinRules, rules: FitRules, cells) -> Scorecards:
    """Fit one scorecard per key on given bins; ``cells(lookup)`` has the design vectors with their sums."""
    keys, numeric, categorical = list(keys), list(numeric), list(categorical)
    look = localize(binning.lookup_row(bins, keys, numeric, categorical), "lookup")
    xs = [f"{f}__woe" for f in numeric + categorical]
    cell = materialize(cells(look), "cells")
    coefs = glm.fit_logits(cell, keys, xs, rules.inverse_penalty)
    return Scorecards(keys, numeric, categorical, bins, coefs,
                      localize(look.join(coefs, keys), "scorecards"), spec.most, cell)
