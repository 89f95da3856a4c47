import pytest

from throughdoor.config import RegionRules
from throughdoor.operators import regions

SPEC = RegionRules(least_applications=4)


def residuals(spark, sizes):
    rows = [("k", z, float(i % 2), 0.4) for z, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, zip3 string, accepted double, p double")
    return regions.zip_residuals(df, ["k"], "p", SPEC)


def test_small_regions_have_a_row_but_no_residual(spark):
    got = {r["zip3"]: r for r in residuals(spark, {"100": 6, "200": 3, "300": 4, "400": 1}).collect()}
    assert {z: r["small"] for z, r in got.items()} == {"100": False, "200": True, "300": False, "400": True}
    assert [got["200"][c] for c in ("z", "excess_rate_pp", "flagged")] == [None] * 3
    assert got["200"]["n_apps"] == 3 and got["200"]["observed_declines"] == 2.0
    assert got["100"]["excess_rate_pp"] == pytest.approx(10.0)


def test_small_regions_are_counted_and_not_judged(spark):
    res = residuals(spark, {"100": 6, "200": 3, "300": 4, "400": 1})
    row = regions.dispersion(res, ["k"], SPEC).first()
    assert (row["n_zip3"], row["n_zip3_small"], row["n_apps_small"]) == (2, 2, 4)
    assert {r["zip3"] for r in regions.top_and_bottom(res).collect()} == {"100", "300"}
    assert {r["zip3"] for r in regions.largest_gaps(res).collect()} == {"100", "300"}


def test_a_key_with_small_regions_only(spark):
    row = regions.dispersion(residuals(spark, {"200": 3, "400": 1}), ["k"], SPEC).first()
    assert (row["n_zip3"], row["n_zip3_small"], row["n_apps_small"]) == (0, 2, 4)
    assert row["chi2_p"] is None and row["dispersion_ratio"] is None and row["iqr_excess_decline_pp"] is None
