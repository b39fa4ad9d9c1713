"""How large a savings plan or storage reservation to buy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions.measures import (
    DAYS_PER_MONTH,
    DAYS_PER_YEAR,
    double,
    mean,
    percent,
    scenario,
)
from commitlens.functions.storage import storage_capacity_class
from commitlens.operators.eligibility import compute_services, sku_prefix_eligible
from commitlens.operators.grouping import project, totals
from commitlens.operators.rollup import daily_rollup, spend_distribution
from commitlens.operators.scope import ChargeWindow, since, storage_scope
from commitlens.operators.sizing import PLAN_DISCOUNT, PLAN_PERCENTS, commitment_sizing, hourly
from commitlens.plans.common import SINCE_OCTOBER, usage_in

SINCE_MARCH = since("2025-03-01")


def savings_plan_sizing(
    charges: DataFrame, window: ChargeWindow = SINCE_MARCH, discount: float = PLAN_DISCOUNT
) -> DataFrame:
    """Distribution of the daily spend that a compute savings plan could cover, as one row."""
    daily = usage_in(charges, window).transform(sku_prefix_eligible).transform(daily_rollup)
    values = ["daily_total_effective", "daily_uncovered_effective"]
    return daily.transform(spend_distribution, values, PLAN_PERCENTS).transform(commitment_sizing, discount)


def sizing_validation(charges: DataFrame, window: ChargeWindow = SINCE_OCTOBER) -> DataFrame:
    """Totals and means per day and hour of compute spend, as one row.

    The scope is by service and not by SKU and the window is shorter than in the sizing report,
    so the two need not agree.
    """
    total, uncovered = "daily_total_effective", "daily_uncovered_effective"
    daily = usage_in(charges, window).transform(compute_services).transform(daily_rollup)
    sums = daily.agg(F.count("usage_day").alias("days"), *totals(total, uncovered))
    return project(sums, [], {
        "TotalDays": "days",
        "Total_EffectiveCost": double(total),
        "Total_AvgDaily": mean(total, "days"),
        "Total_AvgHourly": hourly(mean(total, "days")),
        "Uncovered_EffectiveCost": double(uncovered),
        "Uncovered_AvgDaily": mean(uncovered, "days"),
        "Uncovered_AvgHourly": hourly(mean(uncovered, "days")),
    })


def storage_reservations(
    charges: DataFrame, window: ChargeWindow = SINCE_MARCH, discounts: tuple[float, float] = (0.25, 0.38)
) -> DataFrame:
    """Storage spend by type, region and capacity class, with spread, coverage and savings.

    ``discounts`` are those of one and of three years; the columns are named for the usual ones.
    """
    keys = ["x_SkuMeterSubcategory", "RegionId", "IsCapacityCharge"]
    total, uncovered = "daily_total_effective", "daily_uncovered_effective"
    groups = (
        usage_in(charges, window)
        .transform(storage_scope)
        .withColumn("IsCapacityCharge", storage_capacity_class())
        .transform(daily_rollup, keys)
        .transform(spend_distribution, [total, uncovered], (25, 50, 75), keys)
        .filter(F.col(uncovered) > 0)
        .withColumnRenamed("x_SkuMeterSubcategory", "StorageType")
    )
    daily_mean = f"{uncovered}_mean"
    report = project(groups, ["StorageType", *keys[1:]], {
        "DaysWithUsage": "days",
        "Total_EffectiveCost": double(total),
        "Total_ListCost": double("daily_total_list"),
        "Total_ContractedCost": double("daily_total_contracted"),
        "Total_AvgDailyCost": f"{total}_mean",
        "Total_AvgMonthlyCost": scenario(f"{total}_mean", DAYS_PER_MONTH),
        "Uncovered_EffectiveCost": double(uncovered),
        "Uncovered_ListCost": double("daily_uncovered_list"),
        "Uncovered_ContractedCost": double("daily_uncovered_contracted"),
        "Uncovered_AvgDailyCost": daily_mean,
        "Uncovered_AvgMonthlyCost": scenario(daily_mean, DAYS_PER_MONTH),
        "Uncovered_MinDaily": f"{uncovered}_min",
        "Uncovered_P25_Daily": f"{uncovered}_p25",
        "Uncovered_P50_Daily": f"{uncovered}_p50",
        "Uncovered_P75_Daily": f"{uncovered}_p75",
        "Uncovered_MaxDaily": f"{uncovered}_max",
        "CoverageRatePct": percent(F.col(total) - F.col(uncovered), total),
        "Uncovered_AnnualizedCost": scenario(daily_mean, DAYS_PER_YEAR),
        "EstSavings_1yr_25pct": scenario(daily_mean, DAYS_PER_YEAR, discounts[0]),
        "EstSavings_3yr_38pct": scenario(daily_mean, DAYS_PER_YEAR, discounts[1]),
    })
    return report.orderBy(F.desc("Uncovered_EffectiveCost"))
