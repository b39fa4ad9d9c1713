"""Spend and savings by service, region, pricing category and over three months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions.measures import (
    active_days,
    double,
    monthly_over_90_days,
    savings,
    savings_rate,
)
from commitlens.operators.grouping import distinct, project, totals
from commitlens.operators.rollup import share_of_total
from commitlens.operators.scope import ChargeWindow, last_days
from commitlens.plans.common import SERVICE, usage_in


def service_savings(charges: DataFrame, window: ChargeWindow = last_days(30)) -> DataFrame:
    """List against effective cost by service and region.

    All usage counts, with a commitment or without, so negotiated prices appear as savings too.
    """
    keys = [*SERVICE, "RegionId", "RegionName"]
    groups = (
        usage_in(charges, window)
        .groupBy(*keys)
        .agg(
            *totals("ListCost", "EffectiveCost", "PricingQuantity"),
            *distinct(commitments="CommitmentDiscountId", resources="ResourceId"),
        )
        .filter(F.col("ListCost") > 0)
    )
    report = project(groups, keys, {
        "TotalListCost": double("ListCost"),
        "TotalEffectiveCost": double("EffectiveCost"),
        "TotalSavingsRealized": savings(),
        "SavingsRatePct": savings_rate(),
        "UniqueCommitmentsUsed": "commitments",
        "UniqueResourcesCovered": "resources",
        "TotalPricingQuantity": double("PricingQuantity"),
    })
    return report.orderBy(F.desc("TotalSavingsRealized"))


def coverage_by_pricing_category(
    charges: DataFrame, window: ChargeWindow = last_days(30)
) -> DataFrame:
    """Cost per pricing category and its share of the service category's spend."""
    keys = ["ProviderName", "ServiceCategory", "PricingCategory"]
    groups = (
        usage_in(charges, window)
        .groupBy(*keys)
        .agg(*totals("ListCost", "EffectiveCost"))
        .transform(share_of_total, "EffectiveCost", ["ProviderName", "ServiceCategory"], "share")
    )
    report = project(groups, keys, {
        "TotalListCost": double("ListCost"),
        "TotalEffectiveCost": double("EffectiveCost"),
        "TotalSavingsRealized": savings(),
        "PctOfServiceSpend": "share",
        "SavingsRatePct": savings_rate(),
    })
    return report.orderBy("ProviderName", "ServiceCategory", F.desc("TotalEffectiveCost"))


def top_services(charges: DataFrame, window: ChargeWindow = last_days(90)) -> DataFrame:
    """All services with spend, costliest first, over 90 days and per month of three.

    Its columns speak of three months, so any other window than 90 days back is an error.
    """
    if window.lookback != 90:
        raise ValueError("this report looks back 90 days; use last_days(90, as_of)")
    groups = (
        usage_in(charges, window)
        .groupBy(*SERVICE)
        .agg(
            *totals("EffectiveCost", "ListCost", "PricingQuantity"),
            *distinct(resources="ResourceId"),
            active_days().alias("days"),
        )
        .filter(F.col("EffectiveCost") > 0)
    )
    report = project(groups, SERVICE, {
        "Total3MonthEffectiveCost": double("EffectiveCost"),
        "Total3MonthListCost": double("ListCost"),
        "AvgMonthlyEffectiveCost": monthly_over_90_days("EffectiveCost"),
        "AvgMonthlyListCost": monthly_over_90_days("ListCost"),
        "Total3MonthSavings": savings(),
        "AvgMonthlySavings": monthly_over_90_days(savings()),
        "SavingsRatePct": savings_rate(),
        "UniqueResources": "resources",
        "TotalPricingQuantity": double("PricingQuantity"),
        "DaysWithUsage": "days",
    })
    return report.orderBy(F.desc("Total3MonthEffectiveCost"))
