"""Normal, chi-square and t probabilities as Spark columns.

Spark SQL has no erf. The normal CDF is the rational form of Hart (1968) in
West's (2005) arrangement; the bivariate CDF is Gauss-Legendre quadrature over
the correlation.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: published coefficients, highest power first ---------------
CDF_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
CDF_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
CDF_SWITCH = 7.07106781186547
ROOT_2PI = math.sqrt(2.0 * math.pi)
NODES, NODE_WEIGHTS = np.polynomial.legendre.leggauss(24)
FLOOR = 1e-12


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / F.lit(ROOT_2PI)


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    bulk = F.exp(-a * a / 2.0) * _poly(CDF_NUMERATOR, a) / _poly(CDF_DENOMINATOR, a)
    frac = a + 0.65
    for k in (6.0, 5.0, 4.0, 3.0, 2.0, 1.0):
        frac = a + F.lit(k) / frac
    tail = F.exp(-a * a / 2.0) / frac / F.lit(ROOT_2PI)
    upper = F.when(a < F.lit(CDF_SWITCH), bulk).otherwise(tail)
    return F.when(x > 0, F.lit(1.0) - upper).otherwise(upper)


def bivariate_cdf(h: Column, k: Column, rho: Column) -> Column:
    """P(H <= h, K <= k) at correlation ``rho``, floored at 1e-12."""
    grid = F.array(*[
        F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w"))
        for x, w in zip(NODES, NODE_WEIGHTS)
    ])

    def add(acc, node):
        t = rho * 0.5 * (node["x"] + 1.0)
        om = F.lit(1.0) - t * t
        body = F.exp(-(h * h - 2.0 * t * h * k + k * k) / (2.0 * om)) / F.sqrt(om)
        return acc + node["w"] * 0.5 * rho * body

    area = F.aggregate(grid, F.lit(0.0), add)
    value = normal_cdf(h) * normal_cdf(k) + area / F.lit(2.0 * math.pi)
    return F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), value))


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X > x) for a chi-square variable with integer ``df``, finite series."""
    half = x / 2.0

    def series(first_log: Column, offset: float, steps: Column) -> Column:
        start = F.struct(first_log.alias("lt"), F.exp(first_log).alias("s"))

        def add(acc, i):
            lt = acc["lt"] + F.ln(half) - F.ln(i + F.lit(offset))
            return F.struct(lt.alias("lt"), (acc["s"] + F.exp(lt)).alias("s"))

        many = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(
            F.array().cast("array<int>"))
        return F.aggregate(many, start, add, lambda acc: acc["s"])

    even = series(-half, 0.0, (df / 2 - 1).cast("int"))
    lead = -half + F.ln(half) / 2.0 - F.lit(math.lgamma(1.5))
    odd = F.lit(2.0) * normal_cdf(-F.sqrt(x)) + F.when(
        df > 1, series(lead, 0.5, ((df - 1) / 2 - 1).cast("int"))).otherwise(0.0)
    return F.when(x <= 0, F.lit(1.0)).when(df % 2 == 0, even).otherwise(odd)


def t_upper_tail(t: Column, df: Column) -> Column:
    """P(T > t) for Student's t with integer ``df`` (finite cosine series)."""
    theta = F.atan(t / F.sqrt(df.cast("double")))
    c2 = F.cos(theta) * F.cos(theta)

    def series(first: Column, shift: int, count: Column) -> Column:
        start = F.struct(first.alias("term"), first.alias("s"))

        def add(acc, i):
            j = (2 * i).cast("double")
            term = acc["term"] * c2 * (j - shift) / (j + 1 - shift)
            return F.struct(term.alias("term"), (acc["s"] + term).alias("s"))

        many = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(
            F.array().cast("array<int>"))
        return F.aggregate(many, start, add, lambda acc: acc["s"])

    odd_area = F.lit(2.0 / math.pi) * (theta + F.when(
        df > 1, F.sin(theta) * series(F.cos(theta), 0, ((df - 3) / 2).cast("int"))
    ).otherwise(0.0))
    even_area = F.sin(theta) * series(F.lit(1.0), 1, (df / 2 - 1).cast("int"))
    area = F.when(df % 2 == 0, even_area).otherwise(odd_area)
    return (F.lit(1.0) - area) / 2.0
