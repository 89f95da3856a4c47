import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from throughdoor.functions import draws, fields, normal


def column_values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def trapezoid_cdf(x):
    grid = np.linspace(-12, x, 200_001)
    return float(np.trapezoid(np.exp(-grid**2 / 2), grid) / math.sqrt(2 * math.pi))


def test_normal_cdf(spark):
    xs = [-9.0, -7.5, -3.0, -0.5, 0.0, 0.7, 2.0, 6.0]
    got = column_values(spark, normal.normal_cdf(F.col("x")), [(x,) for x in xs], "x double")
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs]
    assert np.allclose(got, want, atol=1e-15, rtol=1e-7)


def test_bivariate_cdf_at_the_origin(spark):
    rhos = [-0.9, -0.4, 0.0, 0.3, 0.7, 0.95]
    got = column_values(spark, normal.bivariate_cdf(F.col("h"), F.col("h"), F.col("r")),
                        [(0.0, r) for r in rhos], "h double, r double")
    assert np.allclose(got, [0.25 + math.asin(r) / (2 * math.pi) for r in rhos], atol=1e-10)


def test_bivariate_cdf_against_integration(spark):
    points = [(0.5, -1.2, 0.7), (-1.5, 0.3, -0.6), (2.0, 1.0, 0.35)]
    got = column_values(spark, normal.bivariate_cdf(F.col("h"), F.col("k"), F.col("r")), points,
                        "h double, k double, r double")
    for (h, k, r), value in zip(points, got):
        x = np.linspace(-12, h, 40_001)
        inner = np.array([0.5 * math.erfc(-(k - r * t) / math.sqrt(2 * (1 - r * r))) for t in x])
        want = np.trapezoid(np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * inner, x)
        assert abs(value - want) < 1e-7


def test_bivariate_cdf_keeps_its_margin(spark):
    rows = [(h, 8.0, r) for h in (-2.0, -0.5, 0.0, 1.3) for r in (-0.7, 0.0, 0.4, 0.9)]
    got = column_values(spark, normal.bivariate_cdf(F.col("h"), F.col("k"), F.col("r")), rows,
                        "h double, k double, r double")
    assert np.allclose(got, [0.5 * math.erfc(-h / math.sqrt(2)) for h, _, _ in rows], atol=1e-9)


@pytest.mark.parametrize("df", [1, 2, 5, 42, 51])
def test_chi_square_tail(spark, df):
    xs = [0.5 * df, 1.0 * df, 1.8 * df]
    got = column_values(spark, normal.chi_square_tail(F.col("x"), F.lit(df)), [(x,) for x in xs], "x double")
    for x, value in zip(xs, got):
        root = np.linspace(math.sqrt(x), math.sqrt(x) + 40, 400_001)  # in sqrt(x): no pole at 0
        log = (df - 1) * np.log(root) - root**2 / 2 + math.log(2) - df / 2 * math.log(2) - math.lgamma(df / 2)
        assert abs(value - np.trapezoid(np.exp(log), root)) < 1e-6


@pytest.mark.parametrize("df", [1, 2, 3, 4, 5, 19, 20])
def test_t_upper_tail(spark, df):
    got = column_values(spark, normal.t_upper_tail(F.col("t"), F.lit(df)), [(1.3,), (-0.4,)], "t double")
    for t, value in zip((1.3, -0.4), got):
        a = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 200_001)
        area = np.trapezoid(np.cos(a) ** (df - 1), a)
        const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
        assert abs(value - const * area) < 1e-8


def test_draws_do_not_depend_on_partitioning(spark):
    ids = spark.range(2000)
    one = ids.coalesce(1).select("id", draws.uniform("id", "42").alias("u")).collect()
    many = ids.repartition(7).select("id", draws.uniform("id", "42").alias("u")).collect()
    assert dict(one) == dict(many)
    assert dict(one)[1] == 0.14305632803054014
    u = np.array([r["u"] for r in one])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03


def test_poisson_counts_have_mean_and_variance_one(spark):
    k = spark.range(20_000).select(draws.poisson_one(draws.uniform("id", "p")).alias("k"))
    mean, var = k.agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.05


def test_field_rules(spark):
    rows = [(" < 1 year ", "13.5%", "945xx", "Dec-2015", " 36 months", "Charged Off"),
            ("10+ years", " 7 % ", "7", "nonsense", "none", "Fully Paid"),
            ("n/a", "abc", None, None, None, "Current"), (None, None, "12", "Feb-2016", "60", None)]
    df = spark.createDataFrame(rows, "e string, p string, z string, d string, t string, s string")
    got = df.select(fields.employment_years("e"), fields.percent("p"), fields.zip_prefix("z"),
                    fields.month_year("d").cast("string"), fields.leading_months("t"), fields.outcome("s")).collect()
    assert [tuple(r) for r in got] == [
        (0.5, 13.5, "945", "2015-12-01", 36.0, 1.0), (10.0, 7.0, "007", None, None, 0.0),
        (None, None, None, None, None, None), (None, None, "012", "2016-02-01", 60.0, None)]


def test_missing_is_null_never_nan(spark):
    df = spark.createDataFrame([("NaN",), ("inf",), ("1e3",), ("",)], "x string")
    assert [r[0] for r in df.select(fields.number("x")).collect()] == [None, None, 1000.0, None]
    win = df.select(fields.windowed(fields.number("x"), (0.0, 500.0))).collect()
    assert [r[0] for r in win] == [None] * 4
