"""How much of the usage is priced under a commitment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions.measures import double, percent, savings, savings_rate
from commitlens.operators.eligibility import eligible_services
from commitlens.operators.grouping import project
from commitlens.operators.rollup import coverage_rollup
from commitlens.operators.scope import ChargeWindow, between, last_days
from commitlens.plans.common import SERVICE, usage_in

ELIGIBLE_MONTH = between("2026-01-01", "2026-02-01")


def coverage_summary(charges: DataFrame, window: ChargeWindow = last_days(30)) -> DataFrame:
    """Covered and uncovered cost, rates and resources by provider."""
    keys = ["ProviderName"]
    groups = usage_in(charges, window).transform(coverage_rollup, keys)
    report = project(groups, keys, {
        "TotalEffectiveCost": double("EffectiveCost"),
        "TotalListCost": double("ListCost"),
        "CoveredEffectiveCost": double("CoveredEffectiveCost"),
        "CoveredListCost": double("CoveredListCost"),
        "UncoveredEffectiveCost": double("UncoveredEffectiveCost"),
        "UncoveredListCost": double("UncoveredListCost"),
        "CoverageRatePct": percent("CoveredEffectiveCost", "EffectiveCost"),
        "UncoveredRatePct": percent("UncoveredEffectiveCost", "EffectiveCost"),
        "TotalSavings": savings(),
        "OverallSavingsRatePct": savings_rate(),
        "CoveredResources": "CoveredResources",
        "UncoveredResources": "UncoveredResources",
    })
    return report.orderBy(F.desc("TotalEffectiveCost"))


def _by_service(usage: DataFrame) -> DataFrame:
    groups = coverage_rollup(usage, SERVICE).filter(F.col("EffectiveCost") > 0)
    columns: dict[str, Column | str] = {
        "TotalEffectiveCost": double("EffectiveCost"),
        "TotalListCost": double("ListCost"),
        "CoveredEffectiveCost": double("CoveredEffectiveCost"),
        "UncoveredEffectiveCost": double("UncoveredEffectiveCost"),
        "CoverageRatePct": percent("CoveredEffectiveCost", "EffectiveCost"),
        "TotalSavings": savings(),
        "SavingsRatePct": savings_rate(),
        "CoveredResources": "CoveredResources",
        "UncoveredResources": "UncoveredResources",
        "ResourceCovPct": percent("CoveredResources", "Resources"),
    }
    return project(groups, SERVICE, columns).orderBy(F.desc("TotalEffectiveCost"))


def coverage_by_service(charges: DataFrame, window: ChargeWindow = last_days(30)) -> DataFrame:
    """Covered and uncovered cost and resources by service."""
    return _by_service(usage_in(charges, window)).drop("ResourceCovPct")


def eligible_coverage(charges: DataFrame, window: ChargeWindow = last_days(30)) -> DataFrame:
    """Coverage by service, of the services that commitments are sold for."""
    return _by_service(usage_in(charges, window).transform(eligible_services))
