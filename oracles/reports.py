"""One DuckDB query per report.

Groups are summed as decimals first; the outer select turns the sums into doubles and forms the
rates, as the data model asks. Resource counts and coverage are counted directly here, where the
Spark reports work in two steps.
"""

from oracles.fixture import small, with_focus
from oracles.lists import (
    COMPUTE_CATEGORIES,
    COMPUTE_NAMES,
    ELIGIBLE_CATEGORIES,
    ELIGIBLE_NAMES,
    SKU_PREFIXES,
)

USAGE = "ChargeCategory = 'Usage' AND ChargeClass IS DISTINCT FROM 'Correction'"
LAST_30 = "ChargePeriodStart >= DATE '2026-02-14'"
LAST_90 = "ChargePeriodStart >= DATE '2025-12-16'"
OCTOBER = "ChargePeriodStart >= DATE '2025-10-01'"
MARCH = "ChargePeriodStart >= DATE '2025-03-01'"
JANUARY = "ChargePeriodStart >= DATE '2026-01-01' AND ChargePeriodStart < DATE '2026-02-01'"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ELIGIBLE = (
    f"(ServiceName IN ({quoted(ELIGIBLE_NAMES)})"
    f" OR ServiceCategory IN ({quoted(ELIGIBLE_CATEGORIES)}))"
)
COMPUTE = (
    f"(ServiceName IN ({quoted(COMPUTE_NAMES)})"
    f" OR ServiceCategory IN ({quoted(COMPUTE_CATEGORIES)}))"
)
PLAN_SKU = (
    f"len(list_filter([{quoted(SKU_PREFIXES)}],"
    " lambda p: starts_with(x_SkuDescription, p))) > 0"
)
STORAGE = "x_SkuMeterCategory = 'Storage' AND x_SkuMeterSubcategory IS DISTINCT FROM 'Bandwidth'"

COMMITTED = "PricingCategory IS NOT DISTINCT FROM 'Committed'"
NOT_COMMITTED = "PricingCategory IS DISTINCT FROM 'Committed'"

SERVICE = "ProviderName, ServiceCategory, ServiceName"
COMMITMENT = "ProviderName, CommitmentDiscountId, CommitmentDiscountName, CommitmentDiscountType"
DAY = "CAST(ChargePeriodStart AS DATE)"

SUMS = """sum(ListCost) AS l, sum(EffectiveCost) AS e, sum(ContractedCost) AS c,
        sum(PricingQuantity) AS q"""
L, E, C, Q = (f"CAST({x} AS DOUBLE)" for x in "lecq")
SAVED = "CAST(l - e AS DOUBLE)"
SAVED_PCT = f"CASE WHEN l > 0 THEN {SAVED} * 100.0::DOUBLE / {L} ELSE 0::DOUBLE END"


def share(part: str, whole: str) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) * 100.0::DOUBLE"
        f" / CAST({whole} AS DOUBLE) ELSE 0::DOUBLE END"
    )


def grouped(keys: str, scope: str, extra: str, select: str, having: str = "true") -> str:
    """Sums ``l e c q`` and ``extra`` by ``keys`` over ``scope``, then ``select`` of them."""
    by = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return with_focus(f"""
g AS (
    SELECT {head}{SUMS}, {extra}
    FROM focus
    WHERE {scope}
    {by}
)
SELECT {head}{select}
FROM g
WHERE {having}""")


SPLIT = f"""sum(CASE WHEN {COMMITTED} THEN EffectiveCost ELSE 0 END) AS ce,
        sum(CASE WHEN {COMMITTED} THEN ListCost ELSE 0 END) AS cl,
        sum(CASE WHEN {NOT_COMMITTED} THEN EffectiveCost ELSE 0 END) AS ue,
        sum(CASE WHEN {NOT_COMMITTED} THEN ListCost ELSE 0 END) AS ul,
        count(DISTINCT ResourceId) FILTER (WHERE {COMMITTED}) AS cr,
        count(DISTINCT ResourceId) FILTER (WHERE {NOT_COMMITTED}) AS ur,
        count(DISTINCT ResourceId) AS r"""
CE, CL, UE, UL = (f"CAST({x} AS DOUBLE)" for x in ("ce", "cl", "ue", "ul"))

BY_SERVICE = f"""{E} AS TotalEffectiveCost, {L} AS TotalListCost,
    {CE} AS CoveredEffectiveCost, {UE} AS UncoveredEffectiveCost,
    {share("ce", "e")} AS CoverageRatePct, {SAVED} AS TotalSavings, {SAVED_PCT} AS SavingsRatePct,
    cr AS CoveredResources, ur AS UncoveredResources"""


def eligible_coverage(window: str) -> str:
    return grouped(
        SERVICE, f"{USAGE} AND {window} AND {ELIGIBLE}", SPLIT,
        f"{BY_SERVICE}, {share('cr', 'r')} AS ResourceCovPct", "e > 0",
    )


def sizing(scope: str = f"{USAGE} AND {MARCH} AND {PLAN_SKU}") -> str:
    sides = {"Total": "t", "Uncovered": "u"}
    select = ["count(*) AS TotalDays"]
    for name, v in sides.items():
        points = {
            "Min": f"min({v}e)",
            **{f"P{p}_": f"quantile_disc({v}e, {p / 100})" for p in (10, 25, 50, 75, 90)},
            "Max": f"max({v}e)",
        }
        points = {point: f"CAST({value} AS DOUBLE)" for point, value in points.items()}
        points["Avg"] = f"CAST(sum({v}e) AS DOUBLE) / count({v}e)"
        for point, value in points.items():
            select.append(f"{value} AS {name}_{point}Daily")
            select.append(f"{value} / 24 AS {name}_{point}Hourly")
        for cost, column in (("Effective", "e"), ("List", "l"), ("Contracted", "c")):
            select.append(f"CAST(sum({v}{column}) AS DOUBLE) AS {name}_{cost}Cost")
        for p in (25, 50, 90) if name == "Total" else (25, 50):
            select.append(f"{points[f'P{p}_']} / 24 * 8760 AS {name}_P{p}_AnnualCommitment")
        select.append(
            f"CAST(sum({v}e) AS DOUBLE) / nullif(count(*), 0) * 365 AS {name}_AnnualizedSpend"
        )
        select.append(
            f"{points['P50_']} / 24 * 8760 * 0.25::DOUBLE AS {name}_P50_EstimatedAnnualSavings"
        )
    return with_focus(f"""
days AS (
    SELECT {DAY} AS day, {daily_sums()}
    FROM focus
    WHERE {scope}
    GROUP BY 1
)
SELECT {", ".join(select)}
FROM days""")


def daily_sums() -> str:
    costs = {"e": "EffectiveCost", "l": "ListCost", "c": "ContractedCost"}
    return ", ".join(
        [f"sum({cost}) AS t{x}" for x, cost in costs.items()]
        + [
            f"sum(CASE WHEN CommitmentDiscountName IS NULL THEN {cost} ELSE 0 END) AS u{x}"
            for x, cost in costs.items()
        ]
    )


CAPACITY = """CASE WHEN
        (x_SkuMeterSubcategory = 'Premium SSD Managed Disks'
            AND regexp_matches(ChargeDescription, '- P30 |- P40 |- P50 |- P60 |- P80 '))
        OR (x_SkuMeterSubcategory = 'Ultra Disks'
            AND position('Provisioned Capacity' IN ChargeDescription) > 0)
        OR (x_SkuMeterSubcategory IN ('Tiered Block Blob', 'Files', 'Files v2')
            AND position('Data Stored' IN ChargeDescription) > 0)
        OR (position('Backup' IN x_SkuMeterSubcategory) > 0
            AND position('Data Stored' IN ChargeDescription) > 0)
        OR (position('NetApp' IN x_SkuMeterSubcategory) > 0
            AND NOT regexp_matches(ChargeDescription, 'Operations|Snapshots'))
        THEN 'Yes' ELSE 'No' END"""


def storage() -> str:
    mean_t = "CAST(sum(te) AS DOUBLE) / count(te)"
    mean_u = "CAST(sum(ue) AS DOUBLE) / count(ue)"
    return with_focus(f"""
days AS (
    SELECT x_SkuMeterSubcategory AS StorageType, RegionId, {CAPACITY} AS IsCapacityCharge,
        {DAY} AS day, {daily_sums()}
    FROM focus
    WHERE {USAGE} AND {MARCH} AND {STORAGE}
    GROUP BY ALL
)
SELECT StorageType, RegionId, IsCapacityCharge,
    count(*) AS DaysWithUsage,
    CAST(sum(te) AS DOUBLE) AS Total_EffectiveCost,
    CAST(sum(tl) AS DOUBLE) AS Total_ListCost,
    CAST(sum(tc) AS DOUBLE) AS Total_ContractedCost,
    {mean_t} AS Total_AvgDailyCost,
    {mean_t} * 30.44::DOUBLE AS Total_AvgMonthlyCost,
    CAST(sum(ue) AS DOUBLE) AS Uncovered_EffectiveCost,
    CAST(sum(ul) AS DOUBLE) AS Uncovered_ListCost,
    CAST(sum(uc) AS DOUBLE) AS Uncovered_ContractedCost,
    {mean_u} AS Uncovered_AvgDailyCost,
    {mean_u} * 30.44::DOUBLE AS Uncovered_AvgMonthlyCost,
    CAST(min(ue) AS DOUBLE) AS Uncovered_MinDaily,
    CAST(quantile_disc(ue, 0.25) AS DOUBLE) AS Uncovered_P25_Daily,
    CAST(quantile_disc(ue, 0.50) AS DOUBLE) AS Uncovered_P50_Daily,
    CAST(quantile_disc(ue, 0.75) AS DOUBLE) AS Uncovered_P75_Daily,
    CAST(max(ue) AS DOUBLE) AS Uncovered_MaxDaily,
    {share("sum(te) - sum(ue)", "sum(te)")} AS CoverageRatePct,
    {mean_u} * 365 AS Uncovered_AnnualizedCost,
    {mean_u} * 365 * 0.25::DOUBLE AS EstSavings_1yr_25pct,
    {mean_u} * 365 * 0.38::DOUBLE AS EstSavings_3yr_38pct
FROM days
GROUP BY StorageType, RegionId, IsCapacityCharge
HAVING sum(ue) > 0""")


PERIOD = f"""min(ChargePeriodStart) AS first, max(ChargePeriodEnd) AS last,
        count(DISTINCT {DAY}) AS days, count(DISTINCT ServiceName) AS services,
        count(DISTINCT CommitmentDiscountId) AS commitments,
        count(DISTINCT ResourceId) AS resources, count(PricingQuantity) AS quantities"""

SQL = {
    "q01_service_savings": grouped(
        f"{SERVICE}, RegionId, RegionName", f"{USAGE} AND {LAST_30}", PERIOD,
        f"""{L} AS TotalListCost, {E} AS TotalEffectiveCost, {SAVED} AS TotalSavingsRealized,
        {SAVED_PCT} AS SavingsRatePct, commitments AS UniqueCommitmentsUsed,
        resources AS UniqueResourcesCovered, {Q} AS TotalPricingQuantity""", "l > 0",
    ),
    "q02_coverage_summary": grouped(
        "ProviderName", f"{USAGE} AND {LAST_30}", SPLIT,
        f"""{E} AS TotalEffectiveCost, {L} AS TotalListCost, {CE} AS CoveredEffectiveCost,
        {CL} AS CoveredListCost, {UE} AS UncoveredEffectiveCost, {UL} AS UncoveredListCost,
        {share("ce", "e")} AS CoverageRatePct, {share("ue", "e")} AS UncoveredRatePct,
        {SAVED} AS TotalSavings, {SAVED_PCT} AS OverallSavingsRatePct,
        cr AS CoveredResources, ur AS UncoveredResources""",
    ),
    "q03_coverage_by_service": grouped(
        SERVICE, f"{USAGE} AND {LAST_30}", SPLIT, BY_SERVICE, "e > 0"
    ),
    "q04_coverage_by_pricing_category": grouped(
        "ProviderName, ServiceCategory, PricingCategory", f"{USAGE} AND {LAST_30}",
        "count(*) AS n",
        f"""{L} AS TotalListCost, {E} AS TotalEffectiveCost, {SAVED} AS TotalSavingsRealized,
        {E} * 100.0::DOUBLE / nullif(CAST(sum(e) OVER (PARTITION BY ProviderName, ServiceCategory)
            AS DOUBLE), 0) AS PctOfServiceSpend,
        {SAVED_PCT} AS SavingsRatePct""",
    ),
    "q05_commitment_utilization": grouped(
        f"{COMMITMENT}, ServiceCategory, ServiceName, RegionId",
        f"{USAGE} AND {LAST_30} AND CommitmentDiscountId IS NOT NULL", PERIOD,
        f"""days AS DaysUsed, first AS FirstUsage, last AS LastUsage, {L} AS TotalListCost,
        {E} AS TotalEffectiveCost, {SAVED} AS TotalSavings, {SAVED_PCT} AS SavingsRatePct,
        {Q} AS TotalQuantityUsed, {Q} / quantities AS AvgDailyQuantity,
        resources AS UniqueResourcesCovered""",
    ),
    "q06_savings_by_type": grouped(
        "ProviderName, CommitmentDiscountType",
        f"{USAGE} AND {LAST_30} AND CommitmentDiscountId IS NOT NULL", PERIOD,
        f"""commitments AS TotalCommitments, {L} AS TotalListCost, {E} AS TotalEffectiveCost,
        {SAVED} AS TotalSavings, {SAVED_PCT} AS SavingsRatePct,
        services AS ServicesWithCommitments, resources AS UniqueResourcesCovered""",
    ),
    "q07_daily_trend": with_focus(f"""
g AS (
    SELECT {DAY} AS UsageDate, ProviderName, CommitmentDiscountType, {SUMS}, {PERIOD}
    FROM focus
    WHERE {USAGE} AND {LAST_30} AND CommitmentDiscountId IS NOT NULL
    GROUP BY 1, 2, 3
)
SELECT UsageDate, ProviderName, CommitmentDiscountType,
    {L} AS DailyListCost, {E} AS DailyEffectiveCost, {SAVED} AS DailySavings,
    {SAVED_PCT} AS DailySavingsRatePct, {Q} AS DailyQuantity, commitments AS CommitmentsUsed
FROM g"""),
    "q08_top_services_3mo": grouped(
        SERVICE, f"{USAGE} AND {LAST_90}", PERIOD,
        f"""{E} AS Total3MonthEffectiveCost, {L} AS Total3MonthListCost,
        {E} / 3 AS AvgMonthlyEffectiveCost, {L} / 3 AS AvgMonthlyListCost,
        {SAVED} AS Total3MonthSavings, {SAVED} / 3 AS AvgMonthlySavings,
        {SAVED_PCT} AS SavingsRatePct, resources AS UniqueResources,
        {Q} AS TotalPricingQuantity, days AS DaysWithUsage""", "e > 0",
    ),
    "q09_active_commitments": grouped(
        COMMITMENT, f"{USAGE} AND {OCTOBER} AND CommitmentDiscountId IS NOT NULL", PERIOD,
        f"""first AS CommitmentStartDate, {C} AS TotalContractedCost, {E} AS TotalEffectiveCost,
        CAST(c - e AS DOUBLE) AS TotalSavings, {share("c - e", "c")} AS SavingsRatePct,
        services AS ServicesWithCommitments, resources AS UniqueResourcesCovered,
        days AS DaysUsed, last AS LastUsageDate""",
    ),
    "q10_eligible_coverage": eligible_coverage(LAST_30),
    "q10b_eligible_coverage_since": eligible_coverage(OCTOBER),
    "q10c_eligible_coverage_month": eligible_coverage(JANUARY),
    "q11_commitment_details": grouped(
        COMMITMENT,
        f"ChargeClass IS DISTINCT FROM 'Correction' AND {OCTOBER}"
        " AND CommitmentDiscountId IS NOT NULL",
        PERIOD,
        f"""first AS FirstUsageDate, last AS LastUsageDate, {L} AS TotalListCost,
        {E} AS TotalEffectiveCost, {SAVED} AS TotalSavings, {SAVED_PCT} AS SavingsRatePct,
        services AS ServicesWithCommitment, resources AS UniqueResourcesCovered,
        {Q} AS TotalPricingQuantity, days AS DaysWithUsage""",
    ),
    "q12_savings_opportunity": grouped(
        f"{SERVICE}, RegionId",
        f"{USAGE} AND {OCTOBER} AND CommitmentDiscountName IS NULL AND {ELIGIBLE}", PERIOD,
        f"""{E} AS TotalUncoveredCost, {L} AS TotalListCost, {C} AS TotalContractedCost,
        {E} * 0.25::DOUBLE AS EstimatedSavings25Pct, {E} * 0.30::DOUBLE AS EstimatedSavings30Pct,
        {Q} AS TotalPricingQuantity, days AS DaysWithUsage, {E} / nullif(days, 0) AS AvgDailyCost""",
        "e > 0",
    ),
    "q13_hourly_spend": grouped(
        f"{SERVICE}, ChargeDescription, RegionId",
        f"{USAGE} AND {OCTOBER} AND CommitmentDiscountName IS NULL AND {ELIGIBLE}", PERIOD,
        f"""{E} AS TotalUncoveredCost, {L} AS TotalListCost, {C} AS TotalContractedCost,
        {E} / nullif(days * 24, 0) AS UncoveredCostPerHour,
        {L} / nullif(days * 24, 0) AS ListCostPerHour,
        {C} / nullif(days * 24, 0) AS ContractedCostPerHour,
        {Q} AS TotalPricingQuantity, days AS DaysWithUsage, {E} / nullif(days, 0) AS AvgDailyCost""",
        "e > 0",
    ),
    "q14_covered_skus": grouped(
        f"{SERVICE}, SkuId, SkuPriceId, ChargeDescription, RegionId, CommitmentDiscountType,"
        " CommitmentDiscountName",
        f"{USAGE} AND {OCTOBER} AND CommitmentDiscountName IS NOT NULL", PERIOD,
        f"""{E} AS TotalEffectiveCost, {L} AS TotalListCost, {C} AS TotalContractedCost,
        {SAVED} AS TotalSavings, {Q} AS TotalPricingQuantity, days AS DaysWithUsage,
        {E} / nullif(days * 24, 0) AS AvgHourlyCost, {E} / nullif(days, 0) AS AvgDailyCost""",
    ),
    "q15_savings_plan_sizing": sizing(),
    "q16_sizing_validation": grouped(
        "", f"{USAGE} AND {OCTOBER} AND {COMPUTE}",
        f"""count(DISTINCT {DAY}) AS days,
        sum(CASE WHEN CommitmentDiscountName IS NULL THEN EffectiveCost ELSE 0 END) AS ue""",
        f"""days AS TotalDays, {E} AS Total_EffectiveCost,
        {E} / nullif(days, 0) AS Total_AvgDaily, {E} / nullif(days, 0) / 24 AS Total_AvgHourly,
        {UE} AS Uncovered_EffectiveCost, {UE} / nullif(days, 0) AS Uncovered_AvgDaily,
        {UE} / nullif(days, 0) / 24 AS Uncovered_AvgHourly""",
    ),
    "q17_storage_reservations": storage(),
}

# Over a stored table of very small charges, whatever type it stores them as.
SQL |= {
    f"{key}_small_{kind}": small(SQL[key])
    for key in ("q01_service_savings", "q13_hourly_spend")
    for kind in ("decimal", "double")
}
