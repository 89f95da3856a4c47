"""Column rules that turn raw application text into typed fields."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
EMPLOYMENT_YEARS = {
    "< 1 year": 0.5,
    "1 year": 1.0,
    "2 years": 2.0,
    "3 years": 3.0,
    "4 years": 4.0,
    "5 years": 5.0,
    "6 years": 6.0,
    "7 years": 7.0,
    "8 years": 8.0,
    "9 years": 9.0,
    "10+ years": 10.0,
}
BAD_STATUSES = [
    "Charged Off",
    "Default",
    "Does not meet the credit policy. Status:Charged Off",
]
GOOD_STATUSES = [
    "Fully Paid",
    "Does not meet the credit policy. Status:Fully Paid",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and infinities become null; null is the only missing marker."""
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def number(c) -> Column:
    """Text or number to double, null when it does not parse."""
    return finite(_c(c).try_cast("double"))


def windowed(c, window: tuple[float, float]) -> Column:
    c = _c(c)
    return F.when(c.between(F.lit(window[0]), F.lit(window[1])), c)


def band_midpoint(low, high) -> Column:
    return (number(low) + number(high)) / F.lit(2.0)


def employment_years(c) -> Column:
    pairs = [F.lit(x) for kv in EMPLOYMENT_YEARS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.trim(_c(c)))


def percent(c) -> Column:
    return number(F.trim(F.replace(_c(c).cast("string"), F.lit("%"), F.lit(""))))


def zip_prefix(c) -> Column:
    return F.lpad(F.substring(_c(c), 1, 3), 3, "0")


def month_year(c) -> Column:
    return F.try_to_timestamp(_c(c), F.lit("MMM-yyyy")).cast("date")


def iso_date(c) -> Column:
    return _c(c).try_cast("date")


def leading_months(c) -> Column:
    return F.regexp_extract(_c(c), r"(\d+)", 1).try_cast("double")


def outcome(status) -> Column:
    s = _c(status)
    return F.when(s.isin(BAD_STATUSES), F.lit(1.0)).when(s.isin(GOOD_STATUSES), F.lit(0.0))


def filled(c, sentinel: str) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(sentinel))
