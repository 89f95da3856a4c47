"""Four ways to infer outcomes of declined applicants.

A method takes a ``Context`` and returns a ``View``: how each row of everyone
through the door counts once its outcome is inferred (times, weight, bad
weight), the implied bad rates and its diagnostics. Views of all methods, and
of all assumed multiples of the bad rate, are conditional sums over the same
scored rows: one aggregation bins them all, a second one collapses them to
cells. Everything is keyed: one portfolio or a grid of backtest scenarios.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORICAL, NUMERIC, Audit
from ..functions import normal as N
from ..functions.draws import uniform
from ..runtime import localize, materialize, spread
from . import binning, measures, scorecard, selection, tally
from .ordered import quantiles

METHOD_COLUMN = "method"
SCALE_COLUMN = "reject_bad_scale"
SELECTION = "heckman"
NEGLIGIBLE = 1e-9


@dataclass
class Context:
    """What a method may see: outcomes of accepted rows, none of declined ones.

    ``accepted`` and ``declined`` hold (keys, row_id, features, design_w) and
    accepted rows ``bad``; or ``both`` holds all of them with ``s`` (1 accepted,
    0 declined) and ``bad`` null where declined. Two tables are scored and
    written once; ``both`` may be a fan-out that is cheaper to compute than to
    write, and only what is aggregated from it is written. ``multiples`` are
    the assumed bad rates of declines over those of approvals, one or many; with
    many, results have them as ``SCALE_COLUMN``.
    """

    accepted: DataFrame | None
    declined: DataFrame | None
    baseline: scorecard.Scorecards
    keys: list
    spec: Audit = Audit()
    numeric: list = field(default_factory=lambda: list(NUMERIC))
    categorical: list = field(default_factory=lambda: list(CATEGORICAL))
    salt: Column | None = None
    multiples: tuple | None = None
    exclusion: list = field(default_factory=list)
    row_id: str = "app_id"
    both: DataFrame | None = None
    fan: tally.Fan | None = None  # the rows of ``both`` before they fan out; counted in tasks where all methods can
    # fits that a caller already holds for these keys
    propensity: scorecard.Scorecards | None = None
    selection_bins: DataFrame | None = None
    outcome_bins: DataFrame | None = None

    @property
    def features(self):
        return self.numeric + self.categorical

    @property
    def scales(self) -> list:
        """The multiples, and the columns that name them."""
        if self.multiples is None:
            return [(float(self.spec.labelling.decline_multiple), {})]
        return [(float(m), {SCALE_COLUMN: F.lit(float(m))}) for m in self.multiples]

    @property
    def result_keys(self) -> list:
        return [*self.keys, *self.scales[0][1]]

    def stacked(self, *extra: str) -> DataFrame:
        """Both sides: keys, row_id, features, ``extra``, design_w, bad, s."""
        cols = [*self.keys, self.row_id, *self.features, *extra, "design_w"]
        if self.both is not None:
            return self.both.select(*cols, "bad", "s")
        a = self.accepted.select(*cols, F.col("bad").cast("double").alias("bad"), F.lit(1).alias("s"))
        return a.unionByName(self.declined.select(*cols, F.lit(None).cast("double").alias("bad"), F.lit(0).alias("s")))

    @cached_property
    def scored(self) -> DataFrame:
        """Both sides with the baseline PD."""
        if self.both is not None:
            return self.baseline.score(self.both)
        salt = F.lit(str(self.spec.seed)) if self.salt is None else self.salt
        return materialize(spread(self.baseline.score(self.stacked().withColumn("salt", salt))), "scored")

    @cached_property
    def rated(self) -> DataFrame:
        """``scored``, with the approval probability where a fit for it is at hand."""
        return self.propensity.score(self.scored, "propensity") if self.propensity else self.scored

    @cached_property
    def tally(self) -> tally.Tally | None:
        return self.fan and tally.Tally(self.fan, self.keys, self.numeric, self.categorical, self.baseline, self.propensity)

    @cached_property
    def designs(self) -> DataFrame | None:
        """Cells of equal design vectors in both equations, if these have the bins of the scores at hand."""
        if self.exclusion or None in (self.propensity, self.selection_bins, self.outcome_bins):
            return None
        if self.tally:
            return materialize(self.tally.design_cells(), "selection-cells")
        return design_cells(self, self.stacked(), self.numeric, self.propensity.lookup, self.baseline.lookup)

    @cached_property
    def cells(self) -> DataFrame:
        """Rows, weight and squared weight per side, outcome and scores.

        Bounded by the bins of the scorecards, however many rows there are. All
        rates, bands and caps of the methods come from here.
        """
        if self.designs is not None:
            at = self.designs.join(self.baseline.coefs.select(*self.keys, F.col("beta").alias("_b")), self.keys).join(
                self.propensity.coefs.select(*self.keys, F.col("beta").alias("_g")), self.keys)
            pd, approval = (scorecard.probability(selection.linear(beta, [f"{x}__{f}" for f in self.features]))
                            for beta, x in (("_b", "x"), ("_g", "z")))
            return at.select(*self.keys, F.col("s").cast("int").alias("s"), F.when(F.col("s") > 0.5, F.col("y")).alias("bad"),
                             pd.alias("pd"), approval.alias("propensity"), "n", "w", "w2")
        by = [*self.keys, "s", "bad", "pd", *(["propensity"] if self.propensity else [])]
        return materialize(self.rated.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.sum("design_w").alias("w"),
            F.sum(F.col("design_w") * F.col("design_w")).alias("w2")), "score-cells")

    @cached_property
    def sides(self) -> DataFrame:
        """Weight and observed bad rate of each side, one row per key."""
        acc, dec = F.col("s") == 1, F.col("s") == 0
        return localize(self.cells.groupBy(*self.keys).agg(
            F.sum(F.when(acc, F.col("w"))).alias("wa"),
            F.coalesce(F.sum(F.when(dec, F.col("w"))), F.lit(0.0)).alias("wr"),
            F.try_divide(F.sum(F.when(acc, F.col("n") * F.col("bad"))), F.sum(F.when(acc, F.col("n")))).alias("obs")),
            "sides")

    def through_door(self, rejected: DataFrame) -> DataFrame:
        """Add the through-the-door rate to (keys, est_reject_bad_rate)."""
        ttd = ((F.col("wa") * F.col("obs") + F.col("wr") * F.col("est_reject_bad_rate"))
               / (F.col("wa") + F.col("wr")))
        return rejected.join(self.sides, self.keys).select(
            *rejected.columns, ttd.alias("est_ttd_bad_rate"), F.col("obs").alias("accepted_bad_rate"))


@dataclass
class View:
    """How a method counts everyone through the door, and what it estimates.

    ``extend`` adds the columns it needs to the rated rows; ``counts`` are
    variants over those, one per multiple. ``diagnostics`` may have fewer keys
    than ``estimates``. ``weigh(key, group)`` gives the same counts in numpy, for
    rows of one key in a task (``tally.Group``).
    """

    name: str
    ctx: Context
    extend: Callable[[DataFrame], DataFrame]
    counts: list
    estimates: DataFrame
    diagnostics: DataFrame
    weigh: Callable | None = None

    @property
    def rows(self) -> DataFrame:
        """Labelled rows (keys, features, bad, w), at the first multiple."""
        v, cols = self.counts[0], [*self.ctx.keys, *self.ctx.features]
        both = F.array(F.struct(F.lit(1.0).alias("bad"), v.wy.alias("w")),
                       F.struct(F.lit(0.0).alias("bad"), (v.w - v.wy).alias("w")))
        got = self.extend(self.ctx.rated).select(*cols, F.explode(both).alias("t"))
        return got.select(*cols, "t.bad", "t.w").where(F.col("w") > NEGLIGIBLE)


def _per_scale(found: DataFrame, ctx: Context, names) -> DataFrame:
    """(keys, ``<name><i>`` of every multiple i) -> a row per multiple."""
    each = F.explode(F.array(*[
        F.struct(*[c.alias(k) for k, c in tag.items()], *[F.col(f"{x}{i}").alias(x) for x in names])
        for i, (_, tag) in enumerate(ctx.scales)])).alias("v")
    return found.select(*ctx.keys, each).select(*ctx.keys, "v.*")


def _of_rows(column: str) -> Column:
    """Mean over the rows of cells."""
    return F.sum(F.col("n") * F.col(column)) / F.sum("n")


def score_bands(ctx: Context) -> DataFrame:
    """Accepted bad rate per baseline score band, one row per (keys, band).

    Bands are cut on the accepted scores; a band under ``min_band_rows`` rows
    takes the overall rate.
    """
    n = ctx.spec.labelling.bands
    acc = ctx.cells.where("s = 1")
    edges = quantiles(acc, ctx.keys, "pd", [k * (1.0 / n) for k in range(1, n)], rows="n")
    edges = localize(edges.select(*ctx.keys, F.array_distinct("q").alias("edges")), "band-edges")
    banded = acc.join(edges, ctx.keys).withColumn("band", band_index("pd", "edges", n - 1))
    stats = banded.groupBy(*ctx.keys, "band").agg(_of_rows("bad").alias("own"), F.sum("n").alias("n"))
    rate = F.when(F.col("n") >= ctx.spec.labelling.band_rows, F.col("own")).otherwise(F.col("obs"))
    return stats.join(ctx.sides, ctx.keys).join(edges, ctx.keys).select(
        *ctx.keys, "band", "n", rate.alias("band_rate"), "obs", "edges")


def band_index(value: str, edges: str, max_edges: int) -> Column:
    return binning.bin_index(value, edges, max_edges + 1)


def parcel_draw(row_id: str, salt: Column) -> Column:
    return uniform(row_id, F.concat(F.lit("parcel:"), salt))


def parcelling(ctx: Context) -> View:
    """Draw a bad label per decline at the scaled bad rate of its score band."""
    n = ctx.spec.labelling.bands
    bands = score_bands(ctx)
    table = localize(bands.groupBy(*ctx.keys).agg(
        F.first("edges").alias("edges"), F.first("obs").alias("overall"),
        F.map_from_entries(F.collect_list(F.struct("band", "band_rate"))).alias("rates")), "bands")
    held = table.select(*ctx.keys, F.col("edges").alias("_edges"), F.col("overall").alias("_overall"),
                        F.col("rates").alias("_rates"))

    def extend(rows):
        banded = rows.join(held, ctx.keys)
        rate = F.coalesce(F.try_element_at("_rates", band_index("pd", "_edges", n - 1)), F.col("_overall"))
        u = parcel_draw(ctx.row_id, F.col("salt"))
        # a decline's own draw, over what its band says
        return banded.withColumn("_band_rate", F.when(F.col("s") == 0, rate)).withColumn(
            "_draw", F.when(F.col("s") == 0, u)).drop("_edges", "_overall", "_rates")

    def label(m):
        return (F.col("_draw") < F.least(F.lit(1.0), m * F.col("_band_rate"))).cast("double")

    w = F.col("design_w")
    counts = [binning.Variant(F.lit(1), w, w * F.when(F.col("s") == 1, F.col("bad")).otherwise(label(m)), tag)
              for m, tag in ctx.scales]
    multiples = [m for m, _ in ctx.scales]
    rates = {tuple(r[k] for k in ctx.keys): (np.array(r["edges"], dtype=float), np.array(
        [x if (x := (r["rates"] or {}).get(i)) is not None else np.nan if r["overall"] is None else r["overall"]
         for i in range(len(r["edges"]) + 1)], dtype=float)) for r in table.collect()}

    def labels(key, g):
        edges, of_band = rates[key]
        rate = of_band[np.searchsorted(edges, g.pd, side="left")]
        return [(g.draw < np.minimum(1.0, m * rate)).astype(float) for m in multiples]

    def weigh(key, g):
        one = np.ones(len(g.s))
        return [(one, g.w, g.w * np.where(g.s == 1, g.bad, np.where(g.s == 0, x, np.nan))) for x in labels(key, g)]

    if ctx.tally:
        drawn = ctx.tally.declined_means(labels, [f"est_reject_bad_rate{i}" for i in range(len(multiples))])
    else:
        drawn = extend(ctx.scored).where("s = 0").groupBy(*ctx.keys).agg(*[
            F.avg(label(m)).alias(f"est_reject_bad_rate{i}") for i, m in enumerate(multiples)])
    rejected = localize(_per_scale(drawn, ctx, ["est_reject_bad_rate"]), "parcelled")
    extra = table.select(*ctx.keys, (F.size("edges") + 1).alias("n_bands"),
                         F.to_json("rates").alias("band_rates"))
    return View("parcelling", ctx, extend, counts, ctx.through_door(rejected), extra, weigh)


def fuzzy(ctx: Context) -> View:
    """Enter each decline twice, as bad with weight p and good with 1 - p."""
    w, seen = F.col("design_w"), F.col("s") == 1

    def chance(m):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), m * F.col("pd")))

    def entry(m, tag):
        bad, good = w * chance(m), w * (1.0 - chance(m))
        times = (bad > NEGLIGIBLE).cast("int") + (good > NEGLIGIBLE).cast("int")
        as_bad, as_good = (F.when(x > NEGLIGIBLE, x).otherwise(0.0) for x in (bad, good))
        return binning.Variant(F.when(seen, F.lit(1)).otherwise(times), F.when(seen, w).otherwise(as_bad + as_good),
                               F.when(seen, w * F.col("bad")).otherwise(as_bad), tag)

    multiples = [m for m, _ in ctx.scales]

    def weigh(key, g):
        out, known = [], g.s == 1
        for m in multiples:
            p = np.clip(m * g.pd, 0.0, 1.0)
            bad, good = g.w * p, g.w * (1.0 - p)
            bads, goods = bad > NEGLIGIBLE, good > NEGLIGIBLE
            bad, good = np.where(bads, bad, 0.0), np.where(goods, good, 0.0)
            out.append((np.where(known, 1.0, bads * 1.0 + goods), np.where(known, g.w, bad + good), np.where(known, g.w * g.bad, bad)))
        return out

    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    stats = ctx.cells.where("s = 0").groupBy(*ctx.keys).agg(
        mean(F.col("pd")).alias("mean_raw_pd_rejects"),
        *[mean(chance(m)).alias(f"est_reject_bad_rate{i}") for i, (m, _) in enumerate(ctx.scales)],
        *[mean((m * F.col("pd") > 1.0).cast("double")).alias(f"frac_pd_clipped_at_1{i}")
          for i, (m, _) in enumerate(ctx.scales)])
    stats = localize(stats, "fuzzy")
    rejected = _per_scale(stats, ctx, ["est_reject_bad_rate"])
    clipped = _per_scale(stats, ctx, ["frac_pd_clipped_at_1"])
    return View("fuzzy", ctx, lambda rows: rows, [entry(m, tag) for m, tag in ctx.scales], ctx.through_door(rejected),
                stats.select(*ctx.keys, "mean_raw_pd_rejects").join(clipped, ctx.keys), weigh)


def propensity_card(ctx: Context) -> scorecard.Scorecards:
    return scorecard.fit(
        ctx.scored.select(*ctx.keys, *ctx.features, F.col("s").cast("double").alias("y"), "design_w"),
        ctx.keys, ctx.numeric, ctx.categorical, "y", "design_w", ctx.spec.bins, ctx.spec.fit)


def inverse_weights(accepted: DataFrame, keys, p: str, spec, rows: str | None = None) -> DataFrame:
    """Accepted rows with raw and capped inverse-propensity weights.

    The cap is the exact ``weight_percentile`` percentile of the raw weights;
    ``rows`` names the row counts of cells.
    """
    held = accepted.withColumn("p", _approval(p, spec)).withColumn("raw_w", F.lit(1.0) / F.col("p"))
    cap = quantiles(held, keys, "raw_w", [spec.weight_percentile / 100.0], rows=rows)
    cap = localize(cap.select(*keys, F.get("q", F.lit(0)).alias("cap")), "weight-cap")
    return held.join(cap, list(keys)).withColumn(
        "w", F.least(F.col("raw_w"), F.col("cap")) * F.col("design_w"))


def _approval(p: str, spec) -> Column:
    return F.greatest(F.lit(spec.least_approval), F.least(F.lit(1.0), F.col(p)))


def ipw(ctx: Context) -> View:
    """Weight accepted rows by the inverse of their approval probability."""
    rules = ctx.spec.labelling
    acc = ctx.cells.where("s = 1").withColumnRenamed("w", "design_w")
    acc = materialize(inverse_weights(acc, ctx.keys, "propensity", rules, rows="n"), "ipw-cells")
    auc = measures.discrimination_of_totals(ctx.propensity.training_scores(), ctx.keys, "pd")
    used = F.col("w") > 0
    # a cell's rows share one weight but for their design weights
    squares = F.sum(F.when(used, F.pow(F.least("raw_w", "cap"), F.lit(2.0)) * F.col("w2")))
    stats = localize(acc.groupBy(*ctx.keys).agg(
        measures.weighted_mean(F.col("bad"), F.col("w")).alias("est_ttd_bad_rate"),
        _of_rows("p").alias("mean_propensity_accepted"), F.min("p").alias("min_propensity_accepted"),
        (F.sum(F.when(F.col("raw_w") > F.col("cap"), F.col("n")).otherwise(0)) / F.sum("n")).alias("frac_weights_capped"),
        (F.coalesce(F.try_divide(F.pow(F.sum(F.when(used, F.col("w"))), F.lit(2.0)), squares), F.lit(0.0))
         / F.sum("n")).alias("ess_ratio"), F.max("cap").alias("cap")
    ).join(auc.select(*ctx.keys, F.col("auc").alias("propensity_auc")), ctx.keys), "ipw-stats")
    share = F.col("wa") / (F.col("wa") + F.col("wr"))
    implied = ((F.col("est_ttd_bad_rate") - share * F.col("obs"))
               / F.greatest(1.0 - share, F.lit(1e-9)))
    named = [tag[SCALE_COLUMN] for _, tag in ctx.scales if tag]
    multiple = [F.explode(F.array(*named)).alias(SCALE_COLUMN)] if named else []
    estimates = stats.join(ctx.sides, ctx.keys).select(
        *ctx.keys, *multiple,
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), implied)).alias("est_reject_bad_rate"),
        "est_ttd_bad_rate", F.col("obs").alias("accepted_bad_rate"))
    caps = stats.select(*ctx.keys, F.col("cap").alias("_cap"))
    seen = F.col("s") == 1
    capped = F.least(F.lit(1.0) / _approval("propensity", rules), F.col("_cap")) * F.col("design_w")
    counts = [binning.Variant(seen.cast("int"), F.when(seen, capped).otherwise(0.0),
                              F.when(seen, capped * F.col("bad")).otherwise(0.0), tag) for _, tag in ctx.scales]
    most, times, least = {tuple(r[k] for k in ctx.keys): r["_cap"] for r in caps.collect()}, len(ctx.scales), rules.least_approval

    def weigh(key, g):
        known = g.s == 1
        w = np.where(known, np.minimum(1.0 / np.clip(g.propensity, least, 1.0), most[key]) * g.w, 0.0)
        return [(known * 1.0, w, np.where(known, w * g.bad, 0.0))] * times

    return View("ipw", ctx, lambda rows: rows.join(caps, ctx.keys), counts, estimates,
                stats.drop("est_ttd_bad_rate", "cap"), weigh)


@dataclass
class SelectionResult:
    """Fitted selection model: outcome scores, estimates, view totals."""

    keys: list
    fit: selection.SelectionFit
    outcome_bins: DataFrame
    numeric: list
    categorical: list
    estimates: DataFrame
    diagnostics: DataFrame
    view_scores: DataFrame  # (keys, pd, tp, fp)
    lookup: DataFrame
    max_bins: int

    def score(self, rows: DataFrame, pd_name: str = "pd", keep=None) -> DataFrame:
        """Rows with the outcome equation's P(bad)."""
        keep = rows.columns if keep is None else keep
        on = [k for k in self.keys if k in rows.columns]
        extra = [k for k in self.keys if k not in on]
        feats = self.numeric + self.categorical
        woes = binning.woe_columns(self.numeric, self.categorical, self.max_bins, "__own")
        got = rows.join(self.lookup, on).select(
            *[rows[c] for c in keep], *extra, F.col("beta").alias("_beta"), *woes)
        got = got.withColumn("_v", selection.linear("_beta", [f"{f}__own" for f in feats]))
        return got.select(*keep, *extra, scorecard.settled(N.normal_cdf(F.col("_v"))).alias(pd_name))

    def scores_of(self, rows: DataFrame, counts, places: DataFrame | None = None) -> DataFrame:
        """As ``Scorecards.scores_of``, with the outcome equation's P(bad)."""
        look = self.lookup if places is None else self.lookup.join(
            places, [k for k in self.keys if k in places.columns])
        cells = binning.designs(rows, self.keys, look, self.numeric, self.categorical, counts)
        v = selection.linear("beta", [f"{f}__woe" for f in self.numeric + self.categorical])
        return cells.join(self.fit.params.select(*self.keys, "beta"), self.keys).withColumn("_v", v).select(
            *self.keys, scorecard.settled(N.normal_cdf(F.col("_v"))).alias("pd"),
            F.col("swy").alias("tp"), (F.col("sw") - F.col("swy")).alias("fp"))


def design_cells(ctx: Context, both: DataFrame, sel_num, sel_look, out_look) -> DataFrame:
    """Cells (keys, z__*, x__*, s, y) of the rows' weights of evidence in the two equations.

    The rows' bins of both equations, their side and their outcome are one
    design vector of ``binning.designs``.
    """
    keys, w = list(ctx.keys), F.col("design_w")
    zs, xs = [f"z__{f}" for f in sel_num + ctx.categorical], [f"x__{f}" for f in ctx.features]
    own = {**{f"z__{f}": f for f in sel_num + ctx.categorical}, **{f"x__{f}": f for f in ctx.features}, "s": "s", "y": "bad"}
    # a flag is a numeric feature with one edge
    flags = [c for f in ("s", "y") for c in (F.array(F.lit(0.0)).alias(f"{f}__edges"), F.array(F.lit(0.0), F.lit(1.0)).alias(
        f"{f}__woes"), F.lit(0.0).alias(f"{f}__gap"))]
    z_look, x_look = (look.select(*keys, *[F.col(c).alias(f"{p}__{c}") for c in look.columns if "__" in c])
                      for look, p in ((sel_look, "z"), (out_look, "x")))
    look = z_look.join(x_look, keys).select("*", *flags)
    numeric = [*[f"z__{f}" for f in sel_num], *[f"x__{f}" for f in ctx.numeric], "s", "y"]
    categorical = [f"{p}__{f}" for p in "zx" for f in ctx.categorical]
    cells = binning.designs(both, keys, look, numeric, categorical, [binning.Variant(F.lit(1), F.lit(1.0), w, {})],
                            of=lambda f: F.col(own[f]), more={"w2": w * w})
    return materialize(cells.select(*keys, *[F.col(f"{f}__woe").alias(f) for f in [*zs, *xs, "s", "y"]], F.col("swy").alias("w"),
                                    F.col("sw").cast("bigint").alias("n"), "w2"), "selection-cells")


def probit_starts(ctx: Context, sel_num) -> dict:
    """Parameters near the two probit equations, from logistic fits at hand (a probit's are about 1.7 times smaller)."""
    keys, out = ctx.keys, {}
    fits = [(ctx.propensity, [*sel_num, *ctx.categorical]), (ctx.baseline, ctx.features)]
    for at, (card, names) in enumerate(fits):
        rows = card.coefs.select(*keys, "beta").collect() if card else []
        for r in rows:
            known = dict(zip(["intercept", *card.features], r["beta"]))
            out.setdefault(tuple(r[k] for k in keys), [None, None])[at] = [
                known.get(n, 0.0) / 1.702 for n in ["intercept", *names]]
    return {k: [*g, *b, 0.0] for k, (g, b) in out.items() if g and b}


def heckman(ctx: Context) -> SelectionResult:
    """Selection model; variables in ``ctx.exclusion`` enter approval only."""
    keys, feats, spec = ctx.keys, ctx.features, ctx.spec
    extra = [c for c in ctx.exclusion if c not in feats]
    both = ctx.stacked(*extra).withColumn("s", F.col("s").cast("double"))
    sel_num = ctx.numeric + [c for c in extra if c not in ctx.categorical]
    sel_bins = None if extra else ctx.selection_bins
    if sel_bins is None:
        size = localize(both.groupBy(*keys).agg(
            (F.count(F.lit(1)) / F.sum("design_w")).alias("unit")), "mean-weight")
        unit = both.join(size, keys).withColumn("unit_w", F.col("design_w") * F.col("unit"))
        sel_bins = binning.fit_bins(unit, keys, sel_num, ctx.categorical, "s", "unit_w", spec.bins)
    out_bins = ctx.outcome_bins
    if out_bins is None:
        out_bins = binning.fit_bins(both.where("s = 1").withColumn("one", F.lit(1.0)), keys, ctx.numeric,
                                    ctx.categorical, "bad", "one", spec.bins)
    top = spec.bins.most
    sel_look = localize(binning.lookup_row(sel_bins, keys, sel_num, ctx.categorical), "sel-lookup")
    out_look = localize(binning.lookup_row(out_bins, keys, ctx.numeric, ctx.categorical), "out-lookup")
    zs = [f"z__{f}" for f in sel_num + ctx.categorical]
    xs = [f"x__{f}" for f in feats]
    cells = ctx.designs
    if cells is None:
        cells = design_cells(ctx, both, sel_num, sel_look, out_look)
    fit = selection.fit_selection(cells, keys, zs, xs, probit_starts(ctx, sel_num))

    at = cells.join(fit.params.select(*keys, "gamma", "beta", "rho"), keys)
    at = (at.withColumn("h", selection.linear("gamma", zs))
          .withColumn("v", selection.linear("beta", xs)))
    implied = F.when(F.col("s") < 0.5, selection.declined_bad_rate(F.col("h"), F.col("v"), F.col("rho")))
    at = materialize(at.select(*keys, "s", "y", "w", "n", "v", implied.alias("p")), "selection-scored")
    sums = localize(at.groupBy(*keys).agg(
        F.sum(F.when(F.col("s") < 0.5, F.col("n") * F.col("p"))).alias("pr"),
        F.sum(F.when(F.col("s") < 0.5, F.col("n"))).alias("nr"),
        F.sum(F.when(F.col("s") > 0.5, F.col("n") * F.col("y"))).alias("ya"),
        F.sum(F.when(F.col("s") > 0.5, F.col("n"))).alias("na"),
        F.sum(F.when(F.col("s") > 0.5, F.col("w"))).alias("wa"),
        F.coalesce(F.sum(F.when(F.col("s") < 0.5, F.col("w"))), F.lit(0.0)).alias("wr")), "selection-sums")
    rej, obs = F.col("pr") / F.col("nr"), F.col("ya") / F.col("na")
    estimates = sums.select(
        *keys, rej.alias("est_reject_bad_rate"),
        ((F.col("wa") * obs + F.col("wr") * rej) / (F.col("wa") + F.col("wr"))).alias("est_ttd_bad_rate"),
        obs.alias("accepted_bad_rate"))
    share_bad = F.when(F.col("s") > 0.5, F.col("y")).otherwise(F.col("p"))
    view = at.select(*keys, scorecard.settled(N.normal_cdf(F.col("v"))).alias("pd"),
                     (F.col("w") * share_bad).alias("tp"), (F.col("w") * (1.0 - share_bad)).alias("fp"))
    lookup = localize(out_look.join(fit.params.select(*keys, "beta"), keys), "selection-card")
    return SelectionResult(keys, fit, out_bins, ctx.numeric, ctx.categorical, estimates,
                           selection.diagnostics(fit), view, lookup, top)


# Methods that label rows, by name; the selection model works on cells instead.
LABELLING: dict[str, Callable[[Context], View]] = {}


def register(name: str, method: Callable[[Context], View]) -> None:
    """Make a method of your own known to ``infer`` and the backtest."""
    if name == SELECTION:
        raise ValueError(f"{name} is the selection model")
    LABELLING[name] = method


for _name, _method in (("parcelling", parcelling), ("fuzzy", fuzzy), ("ipw", ipw)):
    register(_name, _method)


@dataclass
class Inferred:
    """All requested methods of a context, fitted together."""

    keys: list  # with SCALE_COLUMN if there are many multiples
    views: dict
    cards: scorecard.Scorecards | None
    selection: SelectionResult | None

    def estimates(self) -> DataFrame:
        """(keys, method, est_reject_bad_rate, est_ttd_bad_rate, claimed_gini, claimed_ks)"""
        parts, claims = [], []
        if self.views:
            parts += [v.estimates.withColumn(METHOD_COLUMN, F.lit(n)) for n, v in self.views.items()]
            claims.append(self.cards.training_scores())
        if self.selection:
            parts.append(self.selection.estimates.withColumn(METHOD_COLUMN, F.lit(SELECTION)))
            claims.append(self.selection.view_scores.withColumn(METHOD_COLUMN, F.lit(SELECTION)))
        by = [*self.keys, METHOD_COLUMN]
        rates, scores = parts[0], claims[0]
        for more in parts[1:]:
            rates = rates.unionByName(more)
        for more in claims[1:]:
            scores = scores.unionByName(more)
        claimed = measures.discrimination_of_totals(scores, by, "pd").select(
            *by, F.col("gini").alias("claimed_gini"), F.col("ks").alias("claimed_ks"))
        return rates.join(claimed, by)

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows x methods with each method's PD."""
        parts = []
        if self.cards:
            parts.append(self.cards.score(rows))
        if self.selection:
            parts.append(self.selection.score(rows).withColumn(METHOD_COLUMN, F.lit(SELECTION)))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def scores_of(self, rows: DataFrame, counts, places: DataFrame | None = None) -> DataFrame:
        """(keys, method, pd, tp, fp) of rows counted in variants."""
        parts = [self.cards.scores_of(rows, counts, places)] if self.cards else []
        if self.selection:
            parts.append(self.selection.scores_of(rows, counts, places).withColumn(METHOD_COLUMN, F.lit(SELECTION)))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def infer(ctx: Context, methods=("parcelling", "fuzzy", "ipw", "heckman")) -> Inferred:
    """Run the methods; their views share one binning and one keyed scorecard fit."""
    unknown = [n for n in methods if n not in LABELLING and n != SELECTION]
    if unknown:
        raise ValueError(f"unknown methods {unknown}; known are {[*LABELLING, SELECTION]}")
    if SELECTION in methods and ctx.multiples is not None:
        raise ValueError("the selection model assumes no multiple of the bad rate")
    if "ipw" in methods and ctx.propensity is None:
        ctx = replace(ctx, propensity=propensity_card(ctx))
    views = {n: LABELLING[n](ctx) for n in methods if n != SELECTION}
    cards = None
    if views and ctx.tally and all(v.weigh for v in views.values()):
        keys = [*ctx.result_keys, METHOD_COLUMN]
        parts = [(v.weigh, [{**({SCALE_COLUMN: m} if ctx.multiples else {}), METHOD_COLUMN: name} for m, _ in ctx.scales])
                 for name, v in views.items()]
        bins = binning.bins_of(ctx.tally.totals(parts), keys, ctx.numeric, ctx.categorical, ctx.spec.bins)
        cards = scorecard.fit_bins(bins, keys, ctx.numeric, ctx.categorical, ctx.spec.bins, ctx.spec.fit,
                                   lambda look: ctx.tally.cells(parts, look))
    elif views:
        rows, counts = ctx.rated, []
        for name, view in views.items():
            rows = view.extend(rows)
            counts += [replace(v, tags={**v.tags, METHOD_COLUMN: F.lit(name)}) for v in view.counts]
        cards = scorecard.fit_variants(rows, ctx.keys, [*ctx.result_keys, METHOD_COLUMN], ctx.numeric, ctx.categorical,
                                       counts, ctx.spec.bins, ctx.spec.fit)
    chosen = heckman(ctx) if SELECTION in methods else None
    return Inferred(ctx.result_keys, views, cards, chosen)


def with_exclusion(ctx: Context, columns=("app_year",)) -> SelectionResult:
    return heckman(replace(ctx, exclusion=list(columns)))
