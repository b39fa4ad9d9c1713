"""Each operator by itself, over the whole charge table, so that it can be checked on its own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions import measures as m
from commitlens.functions.storage import storage_capacity_class
from commitlens.operators import eligibility, rollup, scope
from commitlens.operators.grouping import project, totals
from commitlens.operators.sizing import PLAN_PERCENTS, commitment_sizing
from commitlens.plans.common import SERVICE
from commitlens.sources.fixture import AS_OF

COSTS = ("ListCost", "EffectiveCost", "ContractedCost")
DAILY_VALUES = ["daily_total_effective", "daily_uncovered_effective"]


def _charges_of(charges: DataFrame, *columns: str) -> DataFrame:
    return project(charges, columns, {"EffectiveCost": m.double("EffectiveCost")})


def usage_scope(charges: DataFrame) -> DataFrame:
    kept = charges.transform(scope.usage_scope)
    return _charges_of(kept, "ChargeCategory", "ChargeClass", "SkuId")


def charge_window(charges: DataFrame) -> DataFrame:
    kept = scope.charge_window(charges, scope.last_days(30, dt.date.fromisoformat(AS_OF)))
    return _charges_of(kept, "ChargePeriodStart", "SkuId")


def under_commitment(charges: DataFrame) -> DataFrame:
    kept = scope.under_commitment(charges, by="id")
    return _charges_of(kept, "CommitmentDiscountId", "CommitmentDiscountName", "SkuId")


def without_commitment(charges: DataFrame) -> DataFrame:
    kept = scope.without_commitment(charges, by="name")
    return _charges_of(kept, "CommitmentDiscountId", "CommitmentDiscountName", "SkuId")


def coverage_split_pricing(charges: DataFrame) -> DataFrame:
    groups = charges.groupBy(*SERVICE).agg(
        *[m.covered_by_pricing(c).alias(f"Covered{c}") for c in COSTS],
        *[m.uncovered_by_pricing(c).alias(f"Uncovered{c}") for c in COSTS],
    )
    columns = [f"{side}{c}" for side in ("Covered", "Uncovered") for c in COSTS]
    return project(groups, SERVICE, {c: m.double(c) for c in columns})


def uncovered_by_name(charges: DataFrame) -> DataFrame:
    groups = charges.groupBy(*SERVICE).agg(
        *[m.uncovered_by_name(c).alias(f"Uncovered{c}") for c in COSTS]
    )
    return project(groups, SERVICE, {f"Uncovered{c}": m.double(f"Uncovered{c}") for c in COSTS})


def savings(charges: DataFrame) -> DataFrame:
    groups = charges.groupBy(*SERVICE).agg(*totals(*COSTS))
    return project(groups, SERVICE, {
        "ListSavings": m.savings(),
        "ListSavingsPct": m.savings_rate(),
        "ContractedSavings": m.savings(base="ContractedCost"),
        "ContractedSavingsPct": m.savings_rate(base="ContractedCost"),
    })


def coverage_pct(charges: DataFrame) -> DataFrame:
    groups = charges.groupBy(*SERVICE).agg(
        *totals("EffectiveCost"),
        m.covered_by_pricing("EffectiveCost").alias("covered"),
        m.uncovered_by_pricing("EffectiveCost").alias("uncovered"),
    )
    return project(groups, SERVICE, {
        "CoverageRatePct": m.percent("covered", "EffectiveCost"),
        "UncoveredRatePct": m.percent("uncovered", "EffectiveCost"),
    })


def share_of_total(charges: DataFrame) -> DataFrame:
    groups = charges.groupBy(*SERVICE).agg(*totals("EffectiveCost"))
    shared = rollup.share_of_total(groups, "EffectiveCost", ["ProviderName"], "PctOfProviderSpend")
    return shared.select(*SERVICE, "PctOfProviderSpend")


def eligible_services(charges: DataFrame) -> DataFrame:
    kept = charges.transform(eligibility.eligible_services)
    return _charges_of(kept, "ServiceCategory", "ServiceName")


def compute_services(charges: DataFrame) -> DataFrame:
    kept = charges.transform(eligibility.compute_services)
    return _charges_of(kept, "ServiceCategory", "ServiceName")


def sku_prefix_eligible(charges: DataFrame) -> DataFrame:
    return _charges_of(charges.transform(eligibility.sku_prefix_eligible), "x_SkuDescription")


def storage_capacity(charges: DataFrame) -> DataFrame:
    classed = charges.withColumn("IsCapacityCharge", storage_capacity_class())
    return _charges_of(
        classed, "x_SkuMeterSubcategory", "ChargeDescription", "IsCapacityCharge"
    )


def daily_rollup(charges: DataFrame) -> DataFrame:
    daily = rollup.daily_rollup(charges, ["ServiceCategory"])
    sums = [c for c in daily.columns if c.startswith("daily_")]
    return project(daily, ["ServiceCategory", "usage_day"], {c: m.double(c) for c in sums})


def spend_distribution(charges: DataFrame) -> DataFrame:
    keys = ["ServiceName", "RegionId"]
    daily = rollup.daily_rollup(charges, keys)
    spread = rollup.spend_distribution(daily, DAILY_VALUES, PLAN_PERCENTS, keys)
    sums = [c for c in daily.columns if c.startswith("daily_")]
    return spread.drop(*sums)


def sizing(charges: DataFrame) -> DataFrame:
    daily = rollup.daily_rollup(charges)
    return rollup.spend_distribution(daily, DAILY_VALUES, PLAN_PERCENTS).transform(
        commitment_sizing
    )


def per_active_day_rate(charges: DataFrame) -> DataFrame:
    groups = charges.groupBy(*SERVICE).agg(
        *totals("EffectiveCost"), m.active_days().alias("DaysWithUsage")
    )
    return project(groups, [*SERVICE, "DaysWithUsage"], {
        "AvgDailyCost": m.per_active_day("EffectiveCost", "DaysWithUsage"),
        "AvgHourlyCost": m.per_active_day("EffectiveCost", "DaysWithUsage", m.HOURS_PER_DAY),
    })


def resource_coverage(charges: DataFrame) -> DataFrame:
    keys = ["ProviderName", "ServiceCategory"]
    groups = rollup.coverage_rollup(charges, keys)
    return project(groups, keys, {
        "CoveredResources": "CoveredResources",
        "UncoveredResources": "UncoveredResources",
        "Resources": "Resources",
        "ResourceCovPct": m.percent("CoveredResources", "Resources"),
    })


def savings_scenarios(charges: DataFrame) -> DataFrame:
    groups = charges.groupBy(*SERVICE).agg(*totals("EffectiveCost"))
    rates = {"EstimatedSavings25Pct": 0.25, "EstimatedSavings30Pct": 0.30, "EstSavings38Pct": 0.38}
    columns = {name: m.scenario("EffectiveCost", rate) for name, rate in rates.items()}
    return project(groups, SERVICE, columns)


def monthly_normalise(charges: DataFrame) -> DataFrame:
    groups = charges.groupBy(*SERVICE).agg(
        *totals("EffectiveCost"), m.active_days().alias("days")
    )
    daily_mean = m.mean("EffectiveCost", "days")
    return project(groups, SERVICE, {
        "AvgMonthOfThree": m.monthly_over_90_days("EffectiveCost"),
        "AvgMonthlyCost": m.scenario(daily_mean, m.DAYS_PER_MONTH),
    })


def commitment_usage_period(charges: DataFrame) -> DataFrame:
    used = charges.transform(scope.under_commitment)
    return used.groupBy("ProviderName", "CommitmentDiscountId").agg(
        m.first_start().alias("FirstUsage"),
        m.last_end().alias("LastUsage"),
        m.active_days().alias("DaysUsed"),
    )


def storage_scope(charges: DataFrame) -> DataFrame:
    kept = charges.transform(scope.storage_scope)
    return _charges_of(kept, "x_SkuMeterCategory", "x_SkuMeterSubcategory", "SkuId")


def catalog_prefixes(offers: DataFrame) -> DataFrame:
    return _sums_of(offers.transform(eligibility.sku_prefix_eligible), "x_SkuDescription")


def catalog_services(offers: DataFrame) -> DataFrame:
    return _sums_of(offers.transform(eligibility.eligible_services), "ServiceName", "ServiceCategory")


def catalog_compute(offers: DataFrame) -> DataFrame:
    return _sums_of(offers.transform(eligibility.compute_services), "ServiceName", "ServiceCategory")


def _sums_of(offers: DataFrame, *keys: str) -> DataFrame:
    groups = offers.groupBy(*keys).agg(F.count("*").alias("Charges"), *totals("EffectiveCost"))
    return project(groups, keys, {"Charges": "Charges", "EffectiveCost": m.double("EffectiveCost")})


# Over charges that meet every catalog entry.
CATALOGS = {
    "op_sku_prefix_eligible_all": catalog_prefixes,
    "op_eligible_services_all": catalog_services,
    "op_compute_services_all": catalog_compute,
}

OPERATORS = {
    "op_usage_scope": usage_scope,
    "op_charge_window": charge_window,
    "op_under_commitment": under_commitment,
    "op_without_commitment": without_commitment,
    "op_coverage_split_pricing": coverage_split_pricing,
    "op_uncovered_by_name": uncovered_by_name,
    "op_savings": savings,
    "op_coverage_pct": coverage_pct,
    "op_share_of_total": share_of_total,
    "op_eligible_services": eligible_services,
    "op_compute_services": compute_services,
    "op_sku_prefix_eligible": sku_prefix_eligible,
    "op_storage_capacity_class": storage_capacity,
    "op_daily_rollup": daily_rollup,
    "op_spend_distribution": spend_distribution,
    "op_commitment_sizing": sizing,
    "op_per_active_day_rate": per_active_day_rate,
    "op_resource_coverage": resource_coverage,
    "op_savings_scenarios": savings_scenarios,
    "op_monthly_normalise": monthly_normalise,
    "op_commitment_usage_period": commitment_usage_period,
    "op_storage_scope": storage_scope,
}
