"""Column expressions for money, coverage and rates.

Sums stay decimal, hence exact, until the last projection; ratios and scalings are in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_PER_DAY = 24
HOURS_PER_YEAR = 8760
DAYS_PER_YEAR = 365
DAYS_PER_MONTH = 30.44
MONTHS_IN_90_DAYS = 3.0


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def double(value: Column | str) -> Column:
    return _column(value).cast("double")


def usage_day() -> Column:
    return F.to_date("ChargePeriodStart")


# Coverage. Three marks say that a charge is covered: its pricing category, its commitment's id and
# its commitment's name. They can disagree on a charge, so each report uses its own.


def is_committed() -> Column:
    """Priced under a commitment; a charge without a pricing category is not."""
    return F.coalesce(F.col("PricingCategory") == "Committed", F.lit(False))


def is_unnamed() -> Column:
    """Not under a named commitment."""
    return F.col("CommitmentDiscountName").isNull()


def sum_where(condition: Column, measure: str) -> Column:
    """Sum over the rows where ``condition`` holds, 0 where it holds for none."""
    return F.sum(F.when(condition, F.col(measure)).otherwise(0))


def covered_by_pricing(measure: str) -> Column:
    return sum_where(is_committed(), measure)


def uncovered_by_pricing(measure: str) -> Column:
    return sum_where(~is_committed(), measure)


def uncovered_by_name(measure: str) -> Column:
    return sum_where(is_unnamed(), measure)


# Rates over group totals.


def percent(part: Column | str, whole: Column | str) -> Column:
    """``part`` as a percentage of ``whole``, 0 where the whole is not positive."""
    whole = _column(whole)
    return F.when(whole > 0, double(part) * 100.0 / double(whole)).otherwise(F.lit(0.0))


def savings(base: str = "ListCost", effective: str = "EffectiveCost") -> Column:
    return double(F.col(base) - F.col(effective))


def savings_rate(base: str = "ListCost", effective: str = "EffectiveCost") -> Column:
    return percent(F.col(base) - F.col(effective), base)


def per_active_day(total: Column | str, days: Column | str, hours: int = 1) -> Column:
    """``total`` spread over ``days``, or over ``hours`` of each; NULL without any day."""
    return double(total) / F.nullif(_column(days) * hours, F.lit(0))


def mean(total: Column | str, count: Column | str) -> Column:
    return double(total) / F.nullif(_column(count), F.lit(0))


def scenario(base: Column | str, *factors: float) -> Column:
    """``base`` times each factor in turn, such as days in a year and an assumed discount."""
    value = double(base)
    for factor in factors:
        value = value * F.lit(factor)
    return value


def monthly_over_90_days(total: Column | str) -> Column:
    """Mean month of a 90 day total, taken as three months."""
    return double(total) / MONTHS_IN_90_DAYS


# Usage period of a commitment.


def first_start() -> Column:
    return F.min("ChargePeriodStart")


def last_end() -> Column:
    return F.max("ChargePeriodEnd")


def active_days() -> Column:
    return F.countDistinct(usage_day())
