"""Commitment sizes from the distribution of daily spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from commitlens.functions.measures import (
    DAYS_PER_YEAR,
    HOURS_PER_DAY,
    HOURS_PER_YEAR,
    double,
    mean,
    scenario,
)
from commitlens.operators.grouping import project

PLAN_DISCOUNT = 0.25
PLAN_PERCENTS = (10, 25, 50, 75, 90)
# Percentiles that are also shown as a yearly commitment.
ANNUAL_PERCENTS = {"Total": (25, 50, 90), "Uncovered": (25, 50)}


def commitment_sizing(distribution: DataFrame, discount: float = PLAN_DISCOUNT) -> DataFrame:
    """Hourly and yearly commitments from the distribution of daily spend.

    An hour is a 24th of a day, a year 8760 hours. ``Total`` is all spend, ``Uncovered`` the part
    without a named commitment.
    """
    sides = {"Total": "daily_total", "Uncovered": "daily_uncovered"}
    points = {"Min": "min", **{f"P{p}_": f"p{p}" for p in PLAN_PERCENTS}, "Max": "max", "Avg": "mean"}
    columns: dict[str, Column | str] = {"TotalDays": "days"}
    for side, rollup in sides.items():
        daily = {point: f"{rollup}_effective_{stat}" for point, stat in points.items()}
        columns |= {f"{side}_{point}Daily": column for point, column in daily.items()}
        columns |= {f"{side}_{point}Hourly": hourly(column) for point, column in daily.items()}
        columns |= {
            f"{side}_EffectiveCost": double(f"{rollup}_effective"),
            f"{side}_ListCost": double(f"{rollup}_list"),
            f"{side}_ContractedCost": double(f"{rollup}_contracted"),
        }
    for side, rollup in sides.items():
        for p in ANNUAL_PERCENTS[side]:
            columns[f"{side}_P{p}_AnnualCommitment"] = _annual(f"{rollup}_effective_p{p}")
    for side, rollup in sides.items():
        per_day = mean(f"{rollup}_effective", "days")
        columns[f"{side}_AnnualizedSpend"] = scenario(per_day, DAYS_PER_YEAR)
    for side, rollup in sides.items():
        annual = _annual(f"{rollup}_effective_p50")
        columns[f"{side}_P50_EstimatedAnnualSavings"] = scenario(annual, discount)
    return project(distribution, [], columns)


def hourly(daily: Column | str) -> Column:
    return double(daily) / HOURS_PER_DAY


def _annual(daily: Column | str) -> Column:
    return scenario(hourly(daily), HOURS_PER_YEAR)
