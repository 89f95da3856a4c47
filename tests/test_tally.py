"""The methods' counts of a fan, added up in tasks, are those of its fan-out, and the fan-out is not scored."""
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from throughdoor.config import Audit, Masking
from throughdoor.operators import backtest, inference, policy, scorecard

SPEC = Audit(masking=Masking(fit_approved=100, fit_declined=30, replicates=2))
METHODS = ("parcelling", "fuzzy", "ipw")


@pytest.fixture(scope="module")
def context(spark):
    r = random.Random(3)
    rows = [(i, None if r.random() < 0.1 else float(r.randrange(500, 800, 5)), None if r.random() < 0.1 else r.randrange(400) / 10.0,
             None if r.random() < 0.1 else float(r.randrange(11)), float(r.randrange(1000, 9000)),
             r.choice(["AA", "BB", "CC", None]), float(r.random() < 0.25)) for i in range(2500)]
    terminal = spark.createDataFrame(rows, "app_id long, risk_score double, dti double, emp_length_yrs double, "
                                           "amount_requested double, state string, bad double")
    m = backtest.mask(terminal, SPEC, policy.scenario_grid(SPEC.masking, ["risk_soft", "random"], [0.3]))
    fits = backtest._first_fits(m, with_all=True)
    return backtest._context(m, fits.where("role", "base"), propensity=fits.where("role", "propensity"))


def _rows(df, by):
    return {tuple(r[c] for c in by): r for r in df.collect()}


def _close(a, b, by, tolerance=1e-9):
    a, b = _rows(a, by), _rows(b, by)
    assert a.keys() == b.keys() and len(a) > 0
    for k, r in a.items():
        for x, y in zip(r, b[k]):
            assert x == (pytest.approx(y, rel=tolerance, abs=tolerance) if isinstance(y, float) else y), k


def test_counts_in_tasks_are_those_of_the_fan_out(context):
    plain = replace(context, fan=None)
    assert context.tally and not plain.tally
    got, want = (inference.infer(c, METHODS) for c in (context, plain))
    _close(got.estimates(), want.estimates(), ["sid", "method"])
    _close(got.cards.bins.select("sid", "method", "feature", "bin_no", "lo", "hi", "category", "n", "bad"),
           want.cards.bins.select("sid", "method", "feature", "bin_no", "lo", "hi", "category", "n", "bad"),
           ["sid", "method", "feature", "bin_no"], 1e-8)
    cells = [x.cards.cells.groupBy("sid", "method").agg(F.count(F.lit(1)).alias("n"), F.sum("sw").alias("sw"), F.sum("swy").alias("swy"))
             for x in (got, want)]
    _close(*cells, ["sid", "method"], 1e-8)
    both = [c.designs.groupBy("sid", "s", "y").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.sum("w").alias("w"),
                                                   F.sum(F.col("w") * F.col("z__state")).alias("at")) for c in (context, plain)]
    _close(*both, ["sid", "s", "y"], 1e-8)


def test_no_row_is_scored_once_a_scenario(context, monkeypatch):
    def scored(*_, **__):
        raise AssertionError("the fan-out was scored row by row")

    monkeypatch.setattr(scorecard.Scorecards, "score", scored)
    got = inference.infer(replace(context), METHODS)
    assert got.cards.coefs.count() == 3 * context.fan.places.count()
