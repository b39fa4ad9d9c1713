"""Spend that a commitment could cover but does not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions.measures import (
    HOURS_PER_DAY,
    active_days,
    double,
    per_active_day,
    scenario,
)
from commitlens.operators.eligibility import eligible_services
from commitlens.operators.grouping import project, totals
from commitlens.operators.scope import ChargeWindow, without_commitment
from commitlens.plans.common import SERVICE, SINCE_OCTOBER, usage_in


def _uncovered_groups(charges: DataFrame, window: ChargeWindow, keys: Sequence[str]) -> DataFrame:
    return (
        usage_in(charges, window)
        .transform(without_commitment)
        .transform(eligible_services)
        .groupBy(*keys)
        .agg(
            *totals("EffectiveCost", "ListCost", "ContractedCost", "PricingQuantity"),
            active_days().alias("days"),
        )
        .filter(F.col("EffectiveCost") > 0)
    )


def savings_opportunity(
    charges: DataFrame, window: ChargeWindow = SINCE_OCTOBER, discounts: tuple[float, float] = (0.25, 0.30)
) -> DataFrame:
    """Uncovered spend by service and region, and what two discounts would save.

    The columns are named for the usual 25 % and 30 %, whatever ``discounts`` are given.
    """
    keys = [*SERVICE, "RegionId"]
    report = project(_uncovered_groups(charges, window, keys), keys, {
        "TotalUncoveredCost": double("EffectiveCost"),
        "TotalListCost": double("ListCost"),
        "TotalContractedCost": double("ContractedCost"),
        "EstimatedSavings25Pct": scenario("EffectiveCost", discounts[0]),
        "EstimatedSavings30Pct": scenario("EffectiveCost", discounts[1]),
        "TotalPricingQuantity": double("PricingQuantity"),
        "DaysWithUsage": "days",
        "AvgDailyCost": per_active_day("EffectiveCost", "days"),
    })
    return report.orderBy(F.desc("TotalUncoveredCost"))


def hourly_spend(charges: DataFrame, window: ChargeWindow = SINCE_OCTOBER) -> DataFrame:
    """Uncovered spend per hour by charge description and region."""
    keys = [*SERVICE, "ChargeDescription", "RegionId"]
    report = project(_uncovered_groups(charges, window, keys), keys, {
        "TotalUncoveredCost": double("EffectiveCost"),
        "TotalListCost": double("ListCost"),
        "TotalContractedCost": double("ContractedCost"),
        "UncoveredCostPerHour": per_active_day("EffectiveCost", "days", HOURS_PER_DAY),
        "ListCostPerHour": per_active_day("ListCost", "days", HOURS_PER_DAY),
        "ContractedCostPerHour": per_active_day("ContractedCost", "days", HOURS_PER_DAY),
        "TotalPricingQuantity": double("PricingQuantity"),
        "DaysWithUsage": "days",
        "AvgDailyCost": per_active_day("EffectiveCost", "days"),
    })
    return report.orderBy(F.desc("TotalUncoveredCost"))
