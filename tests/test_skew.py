"""One key may hold a large part of the table: results stay whole and the work stays spread."""

import datetime as dt
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from commitlens.operators.rollup import coverage_rollup
from commitlens.operators.scope import last_days
from commitlens.plans import coverage, savings

KEY = ["ProviderName", "ServiceCategory", "ServiceName"]


@pytest.fixture(scope="module")
def skewed(charges):
    """A third of all charges on one service and region, half of those without a resource."""
    pick = F.abs(F.hash("SkuPriceId", "ChargePeriodStart", "ListCost")) % 6
    return (
        charges.withColumn("pick", pick)
        .withColumn("ServiceName", F.when(F.col("pick") < 2, "Hot").otherwise(F.col("ServiceName")))
        .withColumn("ServiceCategory", F.when(F.col("pick") < 2, "Hot").otherwise(F.col("ServiceCategory")))
        .withColumn("ProviderName", F.when(F.col("pick") < 2, "Hot").otherwise(F.col("ProviderName")))
        .withColumn("ResourceId", F.when(F.col("pick") != 0, F.col("ResourceId")))
        .drop("pick")
    )


def test_hot_group_counts_match_brute_force(skewed):
    window = last_days(90, dt.date(2026, 3, 16))
    wanted = defaultdict(lambda: [Decimal(0), set(), set()])
    columns = [*KEY, "EffectiveCost", "ResourceId", "PricingCategory", "ChargeCategory",
               "ChargeClass", "ChargePeriodStart"]
    for r in skewed.select(*columns).collect():
        if r.ChargeCategory != "Usage" or r.ChargeClass == "Correction":
            continue
        if r.ChargePeriodStart < dt.datetime(2025, 12, 16):
            continue
        group = wanted[r.ProviderName, r.ServiceCategory, r.ServiceName]
        group[0] += r.EffectiveCost or 0
        if r.ResourceId is not None:
            group[1 if r.PricingCategory == "Committed" else 2].add(r.ResourceId)
    report = coverage.coverage_by_service(skewed, window).collect()
    found = {
        (r.ProviderName, r.ServiceCategory, r.ServiceName): (
            r.TotalEffectiveCost, r.CoveredResources, r.UncoveredResources
        )
        for r in report
    }
    expected = {
        key: (float(cost), len(covered), len(uncovered))
        for key, (cost, covered, uncovered) in wanted.items()
        if cost > 0
    }
    assert found == expected
    top = savings.top_services(skewed, window).collect()
    resources = {(r.ProviderName, r.ServiceCategory, r.ServiceName): r.UniqueResources for r in top}
    assert resources == {
        key: len(covered | uncovered)
        for key, (cost, covered, uncovered) in wanted.items()
        if cost > 0
    }


def test_hot_group_is_spread_over_its_resources(skewed):
    """The first step groups by resource, so the hot group leaves no partition with a third."""
    plan = coverage_rollup(skewed, KEY)._jdf.queryExecution().executedPlan().toString()
    first_shuffle = [line for line in plan.splitlines() if "hashpartitioning(" in line][1]
    assert "ResourceId" in first_shuffle
