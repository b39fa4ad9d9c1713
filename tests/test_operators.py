"""Each operator on a few literal charges, with the results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import charge_table, values

from commitlens import catalogs
from commitlens.functions import measures as m
from commitlens.functions.storage import storage_capacity_class
from commitlens.operators import eligibility, rollup, scope
from commitlens.operators.sizing import commitment_sizing
from commitlens.plans import commitments, opportunity, sizing
from oracles import lists


def one(df) -> dict:
    (row,) = df.collect()
    return row.asDict()


# Scopes.


def test_usage_scope_drops_only_corrections_and_other_categories(spark):
    charges = charge_table(
        spark,
        {"SkuId": "none"},
        {"SkuId": "regular", "ChargeClass": "Regular"},
        {"SkuId": "correction", "ChargeClass": "Correction"},
        {"SkuId": "purchase", "ChargeCategory": "Purchase"},
        {"SkuId": "untold", "ChargeCategory": None},
    )
    charges = charges.withColumn(
        "ChargeCategory", F.when(F.col("SkuId") != "untold", F.col("ChargeCategory"))
    )
    assert values(scope.usage_scope(charges), "SkuId") == ["none", "regular"]
    every_category = scope.usage_scope(charges, usage_only=False)
    assert values(every_category, "SkuId") == ["none", "purchase", "regular", "untold"]


def test_charge_window_is_closed_below_and_open_above(spark):
    starts = {
        "before": "2025-12-31T23:59:59",
        "first": "2026-01-01T00:00:00",
        "after": "2026-01-01T00:00:01",
        "last": "2026-01-31T23:59:59",
        "end": "2026-02-01T00:00:00",
    }
    charges = charge_table(
        spark, *[{"SkuId": k, "ChargePeriodStart": v} for k, v in starts.items()]
    )
    month = scope.charge_window(charges, scope.between("2026-01-01", "2026-02-01"))
    assert values(month, "SkuId") == ["after", "first", "last"]
    onward = scope.charge_window(charges, scope.since("2026-01-01"))
    assert values(onward, "SkuId") == ["after", "end", "first", "last"]


def test_lookback_starts_at_midnight_and_follows_the_current_date(spark):
    as_of = dt.date(2026, 3, 16)
    assert scope.last_days(30, as_of).start == dt.date(2026, 2, 14)
    assert scope.last_days(90, as_of).start == dt.date(2025, 12, 16)
    today = spark.range(1).select(F.current_date().alias("d")).first().d
    midnight = dt.datetime.combine(today - dt.timedelta(days=30), dt.time())
    charges = charge_table(
        spark,
        {"SkuId": "in", "ChargePeriodStart": midnight},
        {"SkuId": "out", "ChargePeriodStart": midnight - dt.timedelta(seconds=1)},
        {"SkuId": "future", "ChargePeriodStart": midnight + dt.timedelta(days=400)},
    )
    kept = scope.charge_window(charges, scope.last_days(30))
    assert values(kept, "SkuId") == ["future", "in"]


def test_commitment_marks_can_disagree(spark):
    charges = charge_table(
        spark,
        {"SkuId": "both", "CommitmentDiscountId": "c", "CommitmentDiscountName": "C"},
        {"SkuId": "id", "CommitmentDiscountId": "c"},
        {"SkuId": "name", "CommitmentDiscountName": "C"},
        {"SkuId": "neither"},
    )
    assert values(scope.under_commitment(charges), "SkuId") == ["both", "id"]
    assert values(scope.under_commitment(charges, by="name"), "SkuId") == ["both", "name"]
    assert values(scope.without_commitment(charges), "SkuId") == ["id", "neither"]


def test_storage_scope_keeps_unnamed_subcategories(spark):
    charges = charge_table(
        spark,
        {"SkuId": "disk", "x_SkuMeterCategory": "Storage", "x_SkuMeterSubcategory": "Disk"},
        {"SkuId": "null", "x_SkuMeterCategory": "Storage"},
        {"SkuId": "net", "x_SkuMeterCategory": "Storage", "x_SkuMeterSubcategory": "Bandwidth"},
        {"SkuId": "vm", "x_SkuMeterCategory": "Virtual Machines"},
    )
    assert values(scope.storage_scope(charges), "SkuId") == ["disk", "null"]


# Coverage, savings, rates.

PRICED = [
    {"PricingCategory": "Committed", "EffectiveCost": 1},
    {"PricingCategory": "Committed", "EffectiveCost": 2, "CommitmentDiscountName": "C"},
    {"PricingCategory": "Standard", "EffectiveCost": 4},
    {"PricingCategory": "Standard", "EffectiveCost": 8, "CommitmentDiscountName": "C"},
    {"PricingCategory": None, "EffectiveCost": 16},
    {"PricingCategory": None, "EffectiveCost": 32, "CommitmentDiscountName": "C"},
]


def test_coverage_by_pricing_and_by_name_are_different_splits(spark):
    found = one(
        charge_table(spark, *PRICED).agg(
            m.covered_by_pricing("EffectiveCost").cast("int").alias("covered"),
            m.uncovered_by_pricing("EffectiveCost").cast("int").alias("uncovered"),
            m.uncovered_by_name("EffectiveCost").cast("int").alias("unnamed"),
        )
    )
    assert found == {"covered": 3, "uncovered": 60, "unnamed": 21}


@pytest.mark.parametrize(
    ("listed", "effective", "rate"), [(10, 8, 20.0), (0, 8, 0.0), (-10, -4, 0.0), (8, 10, -25.0)]
)
def test_savings_rate_is_zero_without_a_positive_base(spark, listed, effective, rate):
    group = charge_table(spark, {"ListCost": listed, "EffectiveCost": effective})
    found = one(group.select(m.savings().alias("s"), m.savings_rate().alias("r")))
    assert found == {"s": float(listed - effective), "r": rate}


def test_contracted_savings(spark):
    group = charge_table(spark, {"ContractedCost": 20, "EffectiveCost": 15})
    found = one(
        group.select(
            m.savings(base="ContractedCost").alias("s"),
            m.savings_rate(base="ContractedCost").alias("r"),
        )
    )
    assert found == {"s": 5.0, "r": 25.0}


def test_share_of_total_is_null_where_the_total_is_zero(spark):
    groups = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0), ("b", "y", -2.0)], "p string, k string, v double"
    )
    shared = rollup.share_of_total(groups, "v", ["p"], "share")
    found = {(r.p, r.k): r.share for r in shared.collect()}
    assert found == {("a", "x"): 25.0, ("a", "y"): 75.0, ("b", "x"): None, ("b", "y"): None}


def test_rates_per_active_day(spark):
    row = spark.sql("select cast(48 as decimal(18,6)) as t, 2L as days, 0L as none")
    found = one(
        row.select(
            m.per_active_day("t", "days").alias("day"),
            m.per_active_day("t", "days", m.HOURS_PER_DAY).alias("hour"),
            m.per_active_day("t", "none").alias("never"),
        )
    )
    assert found == {"day": 24.0, "hour": 1.0, "never": None}


def test_active_days_count_days_and_not_hours(spark):
    charges = charge_table(
        spark,
        {"ChargePeriodStart": "2026-03-01T00:00:00", "ChargePeriodEnd": "2026-03-02"},
        {"ChargePeriodStart": "2026-03-01T06:00:00", "ChargePeriodEnd": "2026-03-02"},
        {"ChargePeriodStart": "2026-03-05T23:00:00", "ChargePeriodEnd": "2026-03-06"},
    )
    found = one(
        charges.agg(
            m.active_days().alias("days"), m.first_start().alias("first"), m.last_end().alias("last")
        )
    )
    assert found == {"days": 2, "first": dt.datetime(2026, 3, 1), "last": dt.datetime(2026, 3, 6)}


def test_scenarios_and_months(spark):
    row = spark.sql("select cast(120 as decimal(18,6)) as t")
    found = one(
        row.select(
            m.scenario("t", 0.25).alias("quarter"),
            m.scenario("t", m.DAYS_PER_YEAR, 0.25).alias("year"),
            m.monthly_over_90_days("t").alias("month"),
        )
    )
    assert found == {"quarter": 30.0, "year": 10950.0, "month": 40.0}


# Resources.


def test_resource_coverage_counts_a_resource_on_both_sides(spark):
    charges = charge_table(
        spark,
        {"ResourceId": "both", "PricingCategory": "Committed", "EffectiveCost": 1, "ListCost": 2},
        {"ResourceId": "both", "PricingCategory": "Standard", "EffectiveCost": 2, "ListCost": 4},
        {"ResourceId": "covered", "PricingCategory": "Committed", "EffectiveCost": 4, "ListCost": 8},
        {"ResourceId": "unpriced", "PricingCategory": None, "EffectiveCost": 8, "ListCost": 16},
        {"ResourceId": None, "PricingCategory": "Committed", "EffectiveCost": 16, "ListCost": 32},
        {"ResourceId": None, "PricingCategory": "Standard", "EffectiveCost": 32, "ListCost": 64},
    )
    found = one(rollup.coverage_rollup(charges, ["ServiceName"]))
    assert (found["CoveredResources"], found["UncoveredResources"], found["Resources"]) == (2, 2, 3)
    assert (found["CoveredEffectiveCost"], found["UncoveredEffectiveCost"]) == (21, 42)
    assert (found["EffectiveCost"], found["ListCost"]) == (63, 126)


def test_coverage_rollup_agrees_with_direct_distinct_counts(charges):
    keys = ["ProviderName", "ServiceCategory"]
    committed = m.is_committed()
    direct = charges.groupBy(*keys).agg(
        F.sum("EffectiveCost").alias("e"),
        F.countDistinct(F.when(committed, F.col("ResourceId"))).alias("c"),
        F.countDistinct(F.when(~committed, F.col("ResourceId"))).alias("u"),
        F.countDistinct("ResourceId").alias("r"),
    )
    stepwise = rollup.coverage_rollup(charges, keys).select(
        *keys, "EffectiveCost", "CoveredResources", "UncoveredResources", "Resources"
    )
    found, wanted = ([tuple(r) for r in df.collect()] for df in (stepwise, direct))
    assert len(found) == len(wanted) and set(found) == set(wanted)


def test_coverage_rollup_without_costs(spark):
    """Sums of no known cost are NULL on the side that has charges, 0 on the other."""
    blank = {"EffectiveCost": None, "ListCost": None}
    for priced, covered, uncovered in (("Committed", None, 0), ("Standard", 0, None)):
        row = rollup.coverage_rollup(charge_table(spark, {**blank, "PricingCategory": priced}), ["ServiceName"]).first()
        assert row.EffectiveCost is None
        assert (row.CoveredListCost, row.UncoveredListCost) == (covered, uncovered)
    both = charge_table(spark, {**blank, "PricingCategory": "Committed"}, {**blank, "PricingCategory": None})
    row = rollup.coverage_rollup(both, ["ServiceName"]).first()
    assert (row.CoveredEffectiveCost, row.UncoveredEffectiveCost) == (0, 0)


# Eligibility.


def test_catalogs_equal_the_lists_of_the_checks():
    assert tuple(catalogs.service_names()) == lists.ELIGIBLE_NAMES
    assert tuple(catalogs.service_names(*catalogs.COMPUTE_FAMILIES)) == lists.COMPUTE_NAMES
    assert catalogs.ELIGIBLE_CATEGORIES == lists.ELIGIBLE_CATEGORIES
    assert catalogs.COMPUTE_CATEGORIES == lists.COMPUTE_CATEGORIES
    assert catalogs.COMPUTE_PLAN_SKU_PREFIXES == lists.SKU_PREFIXES


def test_no_prefixes_keep_nothing(spark):
    charges = charge_table(spark, {"x_SkuDescription": "anything"}, {"x_SkuDescription": ""})
    assert eligibility.sku_prefix_eligible(charges, ()).count() == 0
    assert eligibility.sku_prefix_eligible(charges, ("",)).count() == 2


def test_catalog_sizes():
    assert len(set(catalogs.service_names())) == len(catalogs.service_names()) == 53
    assert [len(f) for f in catalogs.ELIGIBLE_SERVICES.values()] == [10, 10, 8, 8, 3, 5, 3, 4, 2]
    prefixes = catalogs.COMPUTE_PLAN_SKU_PREFIXES
    assert len(set(prefixes)) == len(prefixes) == 192
    assert all(p == p.strip() and p for p in prefixes)


def test_eligible_by_name_or_category(spark):
    charges = charge_table(
        spark,
        {"ServiceName": "ExpressRoute", "ServiceCategory": "Networking"},
        {"ServiceName": "Load Balancer", "ServiceCategory": "Networking"},
        {"ServiceName": "Odd Database", "ServiceCategory": "Databases"},
        {"ServiceName": "App Service", "ServiceCategory": "Web"},
        {"ServiceName": "batch node", "ServiceCategory": "Compute"},
        {"ServiceName": "express route", "ServiceCategory": "Networking"},
    )
    eligible = eligibility.eligible_services(charges)
    assert values(eligible, "ServiceName") == [
        "App Service", "ExpressRoute", "Odd Database", "batch node",
    ]
    compute = eligibility.compute_services(charges)
    assert values(compute, "ServiceName") == ["App Service", "batch node"]


def test_sku_prefixes(spark):
    hits = ["Virtual Machines D Series", "Virtual Machines F/FS Series - F2", "Flex Consumption - x"]
    misses = [
        "Virtual Machines D series", "virtual machines D Series", "A Virtual Machines D Series",
        "Virtual Machines Qsv9 Series - Q2", "Virtual Machines D", "", None,
        "Dsv5 Series Dedicated Host", "Virtual Machines Dv2.DSv2 Series",
    ]
    charges = charge_table(spark, *[{"x_SkuDescription": t} for t in hits + misses])
    assert values(eligibility.sku_prefix_eligible(charges), "x_SkuDescription") == sorted(hits)


def test_every_sku_prefix_matches_and_no_shortened_one_does(spark):
    prefixes = catalogs.COMPUTE_PLAN_SKU_PREFIXES
    texts = [p + " - x" for p in prefixes] + [p[:-1] for p in prefixes] + [p.swapcase() for p in prefixes]
    charges = spark.createDataFrame([(t,) for t in texts], "x_SkuDescription string")
    kept = {r[0] for r in eligibility.sku_prefix_eligible(charges).collect()}
    assert kept == {t for t in texts if t.startswith(prefixes)} >= {p + " - x" for p in prefixes}


def test_prefix_pattern_treats_signs_as_text_and_stops_at_the_shortest(spark):
    prefixes = ["a.b", "a+", "a.bc", "x"]
    texts = ["a.b", "axb", "a+1", "aa", "a.bd", "x", "ax", "y"]
    charges = spark.createDataFrame([(t,) for t in texts], "x_SkuDescription string")
    kept = eligibility.sku_prefix_eligible(charges, prefixes)
    assert values(kept, "x_SkuDescription") == ["a+1", "a.b", "a.bd", "x"]


@pytest.mark.parametrize(
    ("kind", "text", "expected"),
    [
        ("Premium SSD Managed Disks", "Premium SSD Managed Disks - P30 LRS Disk", "Yes"),
        ("Premium SSD Managed Disks", "Premium SSD Managed Disks - P20 LRS Disk", "No"),
        ("Premium SSD Managed Disks", "Premium SSD Managed Disks - P60", "No"),
        ("Standard SSD Managed Disks", "Standard SSD Managed Disks - P30 LRS Disk", "No"),
        ("Ultra Disks", "Ultra Disks - Provisioned Capacity", "Yes"),
        ("Ultra Disks", "Ultra Disks - Provisioned IOPS", "No"),
        ("Tiered Block Blob", "Tiered Block Blob - Hot LRS Data Stored", "Yes"),
        ("Tiered Block Blob", "Tiered Block Blob - Hot Write Operations", "No"),
        ("Files", "Files - LRS Data Stored", "Yes"),
        ("Files v2", "Files v2 - Hot Data Stored", "Yes"),
        ("Files v2", "Files v2 - Read Operations", "No"),
        ("Files v3", "Files v3 - Data Stored", "No"),
        ("Azure NetApp Files", "Azure NetApp Files - Standard Capacity", "Yes"),
        ("Azure NetApp Files", "Azure NetApp Files - Snapshots", "No"),
        ("Azure NetApp Files", "Azure NetApp Files - Operations", "No"),
        ("Azure NetApp Files", None, "No"),
        ("Backup", "Backup - GRS Data Stored", "Yes"),
        ("Backup", "Backup - data stored", "No"),
        (None, "Storage - Data Stored", "No"),
    ],
)
def test_storage_capacity_class(spark, kind, text, expected):
    charges = charge_table(spark, {"x_SkuMeterSubcategory": kind, "ChargeDescription": text})
    assert one(charges.select(storage_capacity_class().alias("c")))["c"] == expected


# Daily spend.


def spend(spark, *costs, **columns):
    """One charge per cost, on days in a row; None leaves the day out."""
    first = dt.datetime(2026, 3, 1)
    rows = [
        {"EffectiveCost": cost, "ChargePeriodStart": first + dt.timedelta(days=i), **columns}
        for i, cost in enumerate(costs)
        if cost is not None
    ]
    return charge_table(spark, *rows)


VALUES = ["daily_total_effective", "daily_uncovered_effective"]
PERCENTS = (10, 25, 50, 75, 90)


def distribution(charges):
    return rollup.spend_distribution(rollup.daily_rollup(charges), VALUES, PERCENTS)


def test_daily_rollup_merges_the_hours_of_a_day(spark):
    charges = charge_table(
        spark,
        {"ChargePeriodStart": "2026-03-01T00:00:00", "EffectiveCost": 1},
        {"ChargePeriodStart": "2026-03-01T06:00:00", "EffectiveCost": 2, "CommitmentDiscountName": "C"},
        {"ChargePeriodStart": "2026-03-03T00:00:00", "EffectiveCost": 4},
    )
    found = rollup.daily_rollup(charges).orderBy("usage_day").collect()
    assert [(r.usage_day.day, r.daily_total_effective, r.daily_uncovered_effective) for r in found] == [
        (1, 3, 1),
        (3, 4, 4),
    ]


@pytest.mark.parametrize(
    ("costs", "expected"),
    [
        ([7], [7, 7, 7, 7, 7]),
        ([1, 2], [1, 1, 1, 2, 2]),
        ([5, 4, 3, 2, 1], [1, 2, 3, 4, 5]),
        (list(range(1, 11)), [1, 3, 5, 8, 9]),
        ([1, None, 3], [1, 1, 1, 3, 3]),
    ],
)
def test_percentiles_are_observed_days(spark, costs, expected):
    found = one(distribution(spend(spark, *costs)))
    assert [found[f"daily_total_effective_p{p}"] for p in PERCENTS] == expected
    seen = [c for c in costs if c is not None]
    assert found["days"] == len(seen)
    assert found["daily_total_effective_mean"] == sum(seen) / len(seen)
    assert found["daily_total_effective_min"] == min(seen)
    assert found["daily_total_effective_max"] == max(seen)


def test_commitment_sizing(spark):
    found = one(commitment_sizing(distribution(spend(spark, 24, 48, 72, 96))))
    assert found["TotalDays"] == 4
    assert found["Total_P50_Daily"] == 48.0 and found["Total_P50_Hourly"] == 2.0
    assert found["Total_P50_AnnualCommitment"] == 2.0 * 8760
    assert found["Total_P50_EstimatedAnnualSavings"] == 2.0 * 8760 * 0.25
    assert found["Total_AnnualizedSpend"] == 60.0 * 365
    assert found["Uncovered_MaxHourly"] == 4.0 and found["Uncovered_AvgDaily"] == 60.0
    assert len(found) == 48


# Reports on the corners the fixture may not reach.


def test_empty_scopes_give_empty_or_null_results_and_no_error(spark):
    nothing = charge_table(spark, {"ChargeCategory": "Tax"})
    sized = one(sizing.savings_plan_sizing(nothing))
    assert sized["TotalDays"] == 0 and sized["Total_AnnualizedSpend"] is None
    validated = one(sizing.sizing_validation(nothing))
    assert validated["TotalDays"] == 0 and validated["Total_AvgDaily"] is None
    assert opportunity.savings_opportunity(nothing).count() == 0


def test_quantity_mean_is_per_charge(spark):
    charges = charge_table(
        spark,
        *[
            {"CommitmentDiscountId": "c", "PricingQuantity": q, "ChargePeriodStart": "2026-03-01"}
            for q in (1, 2, 6)
        ],
    )
    found = one(commitments.commitment_utilization(charges, scope.since("2026-01-01")))
    assert (found["DaysUsed"], found["AvgDailyQuantity"], found["TotalQuantityUsed"]) == (1, 3.0, 9.0)


def test_details_count_purchases_and_active_commitments_do_not(spark):
    charges = charge_table(
        spark,
        {"CommitmentDiscountId": "c", "EffectiveCost": 1},
        {"CommitmentDiscountId": "c", "EffectiveCost": 2, "ChargeCategory": "Purchase"},
        {"CommitmentDiscountId": "c", "EffectiveCost": 4, "ChargeClass": "Correction"},
    )
    assert one(commitments.commitment_details(charges))["TotalEffectiveCost"] == 3.0
    assert one(commitments.active_commitments(charges))["TotalEffectiveCost"] == 1.0


def test_validation_equals_sizing_on_the_same_scope(charges):
    """The two differ in window and eligibility only."""
    window = scope.since("2025-10-01")
    scoped = eligibility.sku_prefix_eligible(eligibility.compute_services(charges))
    sized = one(sizing.savings_plan_sizing(scoped, window))
    validated = one(sizing.sizing_validation(scoped, window))
    for name in ("TotalDays", "Total_EffectiveCost", "Uncovered_EffectiveCost", "Total_AvgDaily"):
        assert sized[name] == validated[name]
