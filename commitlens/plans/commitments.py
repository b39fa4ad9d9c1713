"""Use of the commitments already bought, and what they save."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions.measures import (
    HOURS_PER_DAY,
    active_days,
    double,
    first_start,
    last_end,
    mean,
    per_active_day,
    savings,
    savings_rate,
    usage_day,
)
from commitlens.operators.grouping import distinct, project, totals
from commitlens.operators.scope import (
    ChargeWindow,
    charge_window,
    last_days,
    under_commitment,
    usage_scope,
)
from commitlens.plans.common import COMMITMENT, SERVICE, SINCE_OCTOBER, usage_in


def commitment_utilization(charges: DataFrame, window: ChargeWindow = last_days(30)) -> DataFrame:
    """Days, period, cost and quantity of each commitment by service and region.

    ``AvgDailyQuantity`` is a mean per charge, not per day.
    """
    keys = [*COMMITMENT, "ServiceCategory", "ServiceName", "RegionId"]
    groups = (
        usage_in(charges, window)
        .transform(under_commitment)
        .groupBy(*keys)
        .agg(
            active_days().alias("days"),
            first_start().alias("first"),
            last_end().alias("last"),
            *totals("ListCost", "EffectiveCost", "PricingQuantity"),
            F.count("PricingQuantity").alias("quantities"),
            *distinct(resources="ResourceId"),
        )
    )
    report = project(groups, keys, {
        "DaysUsed": "days",
        "FirstUsage": "first",
        "LastUsage": "last",
        "TotalListCost": double("ListCost"),
        "TotalEffectiveCost": double("EffectiveCost"),
        "TotalSavings": savings(),
        "SavingsRatePct": savings_rate(),
        "TotalQuantityUsed": double("PricingQuantity"),
        "AvgDailyQuantity": mean("PricingQuantity", "quantities"),
        "UniqueResourcesCovered": "resources",
    })
    return report.orderBy(F.desc("TotalSavings"))


def savings_by_type(charges: DataFrame, window: ChargeWindow = last_days(30)) -> DataFrame:
    """Commitments, services, resources and savings by type of commitment."""
    keys = ["ProviderName", "CommitmentDiscountType"]
    groups = (
        usage_in(charges, window)
        .transform(under_commitment)
        .groupBy(*keys)
        .agg(
            *totals("ListCost", "EffectiveCost"),
            *distinct(
                commitments="CommitmentDiscountId", services="ServiceName", resources="ResourceId"
            ),
        )
    )
    report = project(groups, keys, {
        "TotalCommitments": "commitments",
        "TotalListCost": double("ListCost"),
        "TotalEffectiveCost": double("EffectiveCost"),
        "TotalSavings": savings(),
        "SavingsRatePct": savings_rate(),
        "ServicesWithCommitments": "services",
        "UniqueResourcesCovered": "resources",
    })
    return report.orderBy(F.desc("TotalSavings"))


def daily_trend(charges: DataFrame, window: ChargeWindow = last_days(30)) -> DataFrame:
    """Cost, savings and quantity under commitments, day by day."""
    keys = ["UsageDate", "ProviderName", "CommitmentDiscountType"]
    groups = (
        usage_in(charges, window)
        .transform(under_commitment)
        .groupBy(usage_day().alias("UsageDate"), *keys[1:])
        .agg(
            *totals("ListCost", "EffectiveCost", "PricingQuantity"),
            *distinct(commitments="CommitmentDiscountId"),
        )
    )
    report = project(groups, keys, {
        "DailyListCost": double("ListCost"),
        "DailyEffectiveCost": double("EffectiveCost"),
        "DailySavings": savings(),
        "DailySavingsRatePct": savings_rate(),
        "DailyQuantity": double("PricingQuantity"),
        "CommitmentsUsed": "commitments",
    })
    return report.orderBy(F.desc("UsageDate"), F.desc("DailySavings"))


def active_commitments(charges: DataFrame, window: ChargeWindow = SINCE_OCTOBER) -> DataFrame:
    """Savings of each commitment against contracted prices, and its period of use.

    ``CommitmentStartDate`` is the first use within the window, not the purchase.
    """
    groups = (
        usage_in(charges, window)
        .transform(under_commitment)
        .groupBy(*COMMITMENT)
        .agg(
            first_start().alias("first"),
            last_end().alias("last"),
            active_days().alias("days"),
            *totals("ContractedCost", "EffectiveCost"),
            *distinct(services="ServiceName", resources="ResourceId"),
        )
    )
    report = project(groups, COMMITMENT, {
        "CommitmentStartDate": "first",
        "TotalContractedCost": double("ContractedCost"),
        "TotalEffectiveCost": double("EffectiveCost"),
        "TotalSavings": savings(base="ContractedCost"),
        "SavingsRatePct": savings_rate(base="ContractedCost"),
        "ServicesWithCommitments": "services",
        "UniqueResourcesCovered": "resources",
        "DaysUsed": "days",
        "LastUsageDate": "last",
    })
    return report.orderBy(F.desc("TotalSavings"))


def commitment_details(charges: DataFrame, window: ChargeWindow = SINCE_OCTOBER) -> DataFrame:
    """Savings of each commitment over all charge categories, purchases and taxes included."""
    groups = (
        charges.transform(usage_scope, usage_only=False)
        .transform(charge_window, window)
        .transform(under_commitment)
        .groupBy(*COMMITMENT)
        .agg(
            first_start().alias("first"),
            last_end().alias("last"),
            active_days().alias("days"),
            *totals("ListCost", "EffectiveCost", "PricingQuantity"),
            *distinct(services="ServiceName", resources="ResourceId"),
        )
    )
    report = project(groups, COMMITMENT, {
        "FirstUsageDate": "first",
        "LastUsageDate": "last",
        "TotalListCost": double("ListCost"),
        "TotalEffectiveCost": double("EffectiveCost"),
        "TotalSavings": savings(),
        "SavingsRatePct": savings_rate(),
        "ServicesWithCommitment": "services",
        "UniqueResourcesCovered": "resources",
        "TotalPricingQuantity": double("PricingQuantity"),
        "DaysWithUsage": "days",
    })
    return report.orderBy(F.desc("TotalSavings"))


def covered_skus(charges: DataFrame, window: ChargeWindow = SINCE_OCTOBER) -> DataFrame:
    """SKUs used under a named commitment, with their cost per hour and day."""
    keys = [
        *SERVICE, "SkuId", "SkuPriceId", "ChargeDescription", "RegionId",
        "CommitmentDiscountType", "CommitmentDiscountName",
    ]
    groups = (
        usage_in(charges, window)
        .transform(under_commitment, by="name")
        .groupBy(*keys)
        .agg(
            *totals("EffectiveCost", "ListCost", "ContractedCost", "PricingQuantity"),
            active_days().alias("days"),
        )
    )
    report = project(groups, keys, {
        "TotalEffectiveCost": double("EffectiveCost"),
        "TotalListCost": double("ListCost"),
        "TotalContractedCost": double("ContractedCost"),
        "TotalSavings": savings(),
        "TotalPricingQuantity": double("PricingQuantity"),
        "DaysWithUsage": "days",
        "AvgHourlyCost": per_active_day("EffectiveCost", "days", HOURS_PER_DAY),
        "AvgDailyCost": per_active_day("EffectiveCost", "days"),
    })
    return report.orderBy(F.desc("TotalEffectiveCost"))
