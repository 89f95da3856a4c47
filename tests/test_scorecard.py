import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from throughdoor.config import BinRules, PointRules
from throughdoor.functions.draws import uniform
from throughdoor.operators import binning, glm, measures, scorecard

K = ["k"]


@pytest.fixture(scope="module")
def toy(spark):
    """x ~ N(0,1), c in A..D, logit = -1 + 1.2 x + 0.8 [c = A], from hash draws."""
    base = spark.range(20_000).select(
        "id", F.lit("all").alias("k"),
        (F.sqrt(-2 * F.ln(1 - uniform("id", "a"))) * F.cos(2 * math.pi * uniform("id", "b"))).alias("x"),
        F.substring(F.lit("ABCD"), (F.floor(uniform("id", "c") * 4) + 1).cast("int"), F.lit(1)).alias("c"))
    p = 1 / (1 + F.exp(-(-1.0 + 1.2 * F.col("x") + 0.8 * (F.col("c") == "A").cast("double"))))
    return base.withColumn("bad", (uniform("id", "y") < p).cast("double")).withColumn("w", F.lit(1.0)).cache()


def numeric(rows, spec=BinRules(), w="w"):
    bins = binning.fit_bins(rows, K, ["x"], [], "bad", w, spec).orderBy("bin_no").collect()
    return [b for b in bins if not b["is_missing"]], [b for b in bins if b["is_missing"]]


def test_bad_rates_are_monotone(toy):
    d = np.diff([b["bad_rate"] for b in numeric(toy)[0]])
    assert (d >= -1e-9).all() or (d <= 1e-9).all()


def test_bins_respect_the_minimum_size(toy):
    assert min(b["n"] for b in numeric(toy, BinRules(least_share=0.10))[0]) >= 0.10 * 20_000 * 0.999


def test_missing_is_its_own_bin(toy):
    holes = toy.withColumn("x", F.when(F.col("id") >= 1000, F.col("x")))
    seen, gap = numeric(holes)
    assert len(gap) == 1 and gap[0]["n"] == 1000
    bins = binning.fit_bins(holes, K, ["x"], ["c"])
    woes = binning.encode(holes, bins, K, ["x"], ["c"]).agg(
        F.count("x__woe"), F.sum(F.isnan("x__woe").cast("int"))).first()
    assert tuple(woes) == (20_000, 0)


def test_weights_change_the_bins(toy):
    heavy = toy.withColumn("w10", F.when(F.col("x") > 0, 10.0).otherwise(1.0))
    a, b = numeric(toy)[0], numeric(heavy, w="w10")[0]
    assert not np.allclose([r["woe"] for r in a][:2], [r["woe"] for r in b][:2])


def test_a_feature_without_values_scores_zero(toy):
    empty = toy.withColumn("x", F.lit(None).cast("double"))
    seen, gap = numeric(empty)
    assert not seen and gap[0]["woe"] == 0.0
    bins = binning.fit_bins(empty, K, ["x"], [])
    got = binning.encode(toy, bins, K, ["x"], []).agg(F.min("x__woe"), F.max("x__woe")).first()
    assert tuple(got) == (0.0, 0.0)


def test_rare_and_unseen_levels_take_the_pooled_woe(toy):
    rare = toy.withColumn("c", F.when(F.col("id") < 30, "Z").when(F.col("id") < 60, "Y").otherwise(F.col("c")))
    bins = binning.fit_bins(rare, K, [], ["c"]).collect()
    other = [b for b in bins if b["category"] == "__OTHER__"][0]
    assert other["n"] == 60
    frame = binning.fit_bins(rare, K, [], ["c"])
    probe = toy.limit(3).withColumn("c", F.element_at(F.array(F.lit("Z"), F.lit("new"), F.lit(None)),
                                                     (F.row_number().over(Window.orderBy("id"))).cast("int")))
    got = {r["c__woe"] for r in binning.encode(probe, frame, K, [], ["c"]).collect()}
    assert got == {other["woe"]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.floats(0, 1)), min_size=1, max_size=25))
def test_coarsening_keeps_totals_and_limits(cells):
    weight = [float(n) for n, _ in cells]
    bad = [n * r for n, r in cells]
    spec = BinRules()
    got = binning.coarsen(list(range(len(cells))), weight, bad, sum(weight), spec)
    assert np.isclose(sum(got.weight), sum(weight)) and np.isclose(sum(got.bad), sum(bad))
    assert 1 <= len(got) <= spec.most and got.tops[-1] == len(cells) - 1
    assert len(got) <= 2 or min(got.weight) >= spec.least_share * sum(weight) - 1e-9


@pytest.fixture(scope="module")
def card(toy):
    return scorecard.fit(toy, K, ["x"], ["c"])


def test_points_are_the_scaled_log_odds(toy, card):
    factor, offset = scorecard.points_scale(PointRules())
    rows = card.score(toy, "pd", keep=["id", "x", "c"], logit="lo").withColumn(
        "points", scorecard.points(F.col("lo")))
    assert rows.where(F.abs(F.col("points") - (offset - factor * F.col("lo"))) > 1e-9).count() == 0
    table = {(r["feature"], r["bin_no"]): r["points"] for r in card.points_table().collect()}
    bins = card.bins.collect()
    for r in rows.limit(20).collect():
        x = [b for b in bins if b["feature"] == "x" and (b["lo"] is None or r["x"] > b["lo"])
             and (b["hi"] is None or r["x"] <= b["hi"])][0]
        c = [b for b in bins if b["category"] == r["c"]][0]
        assert abs(table[("x", x["bin_no"])] + table[("c", c["bin_no"])] - r["points"]) < 1e-9


def test_scorecard_beats_chance(toy, card):
    assert measures.discrimination(card.score(toy), K, "pd", "bad", "w").first()["gini"] > 0.4


def test_score_equations_hold(toy, card):
    """At the optimum the penalised gradient is zero."""
    rows = binning.encode(toy, card.bins, K, ["x"], ["c"])
    pd_rows = card.score(rows.select(*toy.columns, "x__woe", "c__woe"))
    g = pd_rows.agg(F.sum(F.col("bad") - F.col("pd")), F.sum((F.col("bad") - F.col("pd")) * F.col("x__woe")),
                    F.sum((F.col("bad") - F.col("pd")) * F.col("c__woe"))).first()
    beta = card.coefs.first()["beta"]
    assert np.allclose([g[0], g[1] - beta[1], g[2] - beta[2]], 0, atol=1e-6)


def test_fits_say_whether_they_settled(toy, card, monkeypatch):
    got = card.coefs.first()
    assert got["converged"] and 3 <= got["rounds"] < glm.MAX_ROUNDS
    monkeypatch.setattr(glm, "MAX_ROUNDS", 2)
    with pytest.warns(UserWarning, match="did not settle"):
        late = glm.fit_logits(card.cells, K, ["x__woe", "c__woe"], 1.0).first()
    assert not late["converged"] and late["rounds"] == 2


def test_one_fit_does_not_depend_on_how_cells_are_spread(toy, card):
    xs = ["x__woe", "c__woe"]
    one = glm.fit_logits(card.cells.coalesce(1), K, xs, 1.0).first()["beta"]
    many = glm.fit_logits(card.cells.repartition(9), K, xs, 1.0).first()["beta"]
    assert np.allclose(one, many, atol=1e-9)


def test_equals_the_library_logistic_regression(toy, card):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = binning.encode(toy, card.bins, K, ["x"], ["c"])
    data = VectorAssembler(inputCols=["x__woe", "c__woe"], outputCol="features").transform(rows)
    m = LogisticRegression(labelCol="bad", regParam=1 / 20_000, elasticNetParam=0.0, standardization=False,
                           tol=1e-12, maxIter=200).fit(data)
    assert np.allclose(card.coefs.first()["beta"], [m.intercept, *m.coefficients], atol=1e-5)


def test_keyed_fit_equals_separate_fits(toy):
    two = toy.withColumn("k", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    both = {r["k"]: r["beta"] for r in scorecard.fit(two, K, ["x"], ["c"]).coefs.collect()}
    for k in ("even", "odd"):
        alone = scorecard.fit(two.where(F.col("k") == k), K, ["x"], ["c"]).coefs.first()["beta"]
        assert np.allclose(both[k], alone, atol=1e-9)
