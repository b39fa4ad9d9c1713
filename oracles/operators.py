"""One DuckDB query per operator, over the whole fixture."""

from oracles.fixture import with_focus
from oracles.lists import COMPUTE_CATEGORIES, COMPUTE_NAMES, ELIGIBLE_CATEGORIES, ELIGIBLE_NAMES, SKU_PREFIXES
from oracles.reports import (
    CAPACITY,
    COMMITTED,
    COMPUTE,
    DAY,
    ELIGIBLE,
    LAST_30,
    NOT_COMMITTED,
    PLAN_SKU,
    SAVED,
    SAVED_PCT,
    SERVICE,
    SPLIT,
    STORAGE,
    USAGE,
    E,
    daily_sums,
    grouped,
    quoted,
    share,
    sizing,
)

COST = "CAST(EffectiveCost AS DOUBLE) AS EffectiveCost"
COSTS = ("ListCost", "EffectiveCost", "ContractedCost")


def rows(columns: str, scope: str) -> str:
    return with_focus(f"SELECT {columns}, {COST} FROM focus WHERE {scope}")


def sums_where(prefix: str, condition: str) -> str:
    return ", ".join(
        f"CAST(sum(CASE WHEN {condition} THEN {c} ELSE 0 END) AS DOUBLE) AS {prefix}{c}"
        for c in COSTS
    )


def distribution() -> str:
    select = ["ServiceName", "RegionId", "count(*) AS days"]
    for v, name in (("te", "daily_total_effective"), ("ue", "daily_uncovered_effective")):
        select.append(f"CAST(min({v}) AS DOUBLE) AS {name}_min")
        select += [
            f"CAST(quantile_disc({v}, {p / 100}) AS DOUBLE) AS {name}_p{p}"
            for p in (10, 25, 50, 75, 90)
        ]
        select.append(f"CAST(max({v}) AS DOUBLE) AS {name}_max")
        select.append(f"CAST(sum({v}) AS DOUBLE) / count({v}) AS {name}_mean")
    return with_focus(f"""
days AS (
    SELECT ServiceName, RegionId, {DAY} AS day, {daily_sums()} FROM focus GROUP BY ALL
)
SELECT {", ".join(select)} FROM days GROUP BY ServiceName, RegionId""")


DAILY_NAMES = {
    "te": "daily_total_effective",
    "tl": "daily_total_list",
    "tc": "daily_total_contracted",
    "ue": "daily_uncovered_effective",
    "ul": "daily_uncovered_list",
    "uc": "daily_uncovered_contracted",
}
DAYS = f"count(DISTINCT {DAY}) AS days"

SQL = {
    "op_usage_scope": rows("ChargeCategory, ChargeClass, SkuId", USAGE),
    "op_charge_window": rows("ChargePeriodStart, SkuId", LAST_30),
    "op_under_commitment": rows(
        "CommitmentDiscountId, CommitmentDiscountName, SkuId", "CommitmentDiscountId IS NOT NULL"
    ),
    "op_without_commitment": rows(
        "CommitmentDiscountId, CommitmentDiscountName, SkuId", "CommitmentDiscountName IS NULL"
    ),
    "op_coverage_split_pricing": with_focus(
        f"SELECT {SERVICE}, {sums_where('Covered', COMMITTED)},"
        f" {sums_where('Uncovered', NOT_COMMITTED)} FROM focus GROUP BY {SERVICE}"
    ),
    "op_uncovered_by_name": with_focus(
        f"SELECT {SERVICE}, {sums_where('Uncovered', 'CommitmentDiscountName IS NULL')}"
        f" FROM focus GROUP BY {SERVICE}"
    ),
    "op_savings": grouped(
        SERVICE, "true", "count(*) AS n",
        f"""{SAVED} AS ListSavings, {SAVED_PCT} AS ListSavingsPct,
        CAST(c - e AS DOUBLE) AS ContractedSavings, {share("c - e", "c")} AS ContractedSavingsPct""",
    ),
    "op_coverage_pct": grouped(
        SERVICE, "true", SPLIT,
        f"{share('ce', 'e')} AS CoverageRatePct, {share('ue', 'e')} AS UncoveredRatePct",
    ),
    "op_share_of_total": grouped(
        SERVICE, "true", "count(*) AS n",
        f"""{E} * 100.0::DOUBLE / nullif(CAST(sum(e) OVER (PARTITION BY ProviderName) AS DOUBLE), 0)
        AS PctOfProviderSpend""",
    ),
    "op_eligible_services": rows("ServiceCategory, ServiceName", ELIGIBLE),
    "op_compute_services": rows("ServiceCategory, ServiceName", COMPUTE),
    "op_sku_prefix_eligible": rows("x_SkuDescription", PLAN_SKU),
    "op_storage_capacity_class": rows(
        f"x_SkuMeterSubcategory, ChargeDescription, {CAPACITY} AS IsCapacityCharge", "true"
    ),
    "op_daily_rollup": with_focus(f"""
days AS (SELECT ServiceCategory, {DAY} AS usage_day, {daily_sums()} FROM focus GROUP BY ALL)
SELECT ServiceCategory, usage_day,
    {", ".join(f"CAST({short} AS DOUBLE) AS {name}" for short, name in DAILY_NAMES.items())}
FROM days"""),
    "op_spend_distribution": distribution(),
    "op_commitment_sizing": sizing("true"),
    "op_per_active_day_rate": grouped(
        SERVICE, "true", DAYS,
        f"""days AS DaysWithUsage, {E} / nullif(days, 0) AS AvgDailyCost,
        {E} / nullif(days * 24, 0) AS AvgHourlyCost""",
    ),
    "op_resource_coverage": grouped(
        "ProviderName, ServiceCategory", "true", SPLIT,
        f"""cr AS CoveredResources, ur AS UncoveredResources, r AS Resources,
        {share("cr", "r")} AS ResourceCovPct""",
    ),
    "op_savings_scenarios": grouped(
        SERVICE, "true", "count(*) AS n",
        f"""{E} * 0.25::DOUBLE AS EstimatedSavings25Pct, {E} * 0.30::DOUBLE AS EstimatedSavings30Pct,
        {E} * 0.38::DOUBLE AS EstSavings38Pct""",
    ),
    "op_monthly_normalise": grouped(
        SERVICE, "true", DAYS,
        f"""{E} / 3 AS AvgMonthOfThree,
        {E} / nullif(days, 0) * 30.44::DOUBLE AS AvgMonthlyCost""",
    ),
    "op_commitment_usage_period": with_focus(f"""
SELECT ProviderName, CommitmentDiscountId, min(ChargePeriodStart) AS FirstUsage,
    max(ChargePeriodEnd) AS LastUsage, count(DISTINCT {DAY}) AS DaysUsed
FROM focus
WHERE CommitmentDiscountId IS NOT NULL
GROUP BY ProviderName, CommitmentDiscountId"""),
    "op_storage_scope": rows("x_SkuMeterCategory, x_SkuMeterSubcategory, SkuId", STORAGE),
}


def _entry(values) -> str:
    return f"list_extract([{quoted(values)}], (l_partkey % {len(values)} + 1)::INTEGER)"


def catalog(keys: str, scope: str = "true") -> str:
    """Every entry of the lists, by the part keys of the lines that it is dealt to."""
    return f"""
WITH offers AS (
    SELECT {_entry(SKU_PREFIXES)} || ' - ' || l_linenumber AS x_SkuDescription,
        CASE WHEN l_linenumber % 2 = 0 THEN {_entry(ELIGIBLE_NAMES)} ELSE 'None' END AS ServiceName,
        CASE WHEN l_linenumber % 2 = 0 THEN 'None' ELSE {_entry(ELIGIBLE_CATEGORIES)} END AS ServiceCategory,
        CAST(l_extendedprice AS DECIMAL(18,6)) AS EffectiveCost
    FROM lineitem
)
SELECT {keys}, count(*) AS Charges, CAST(sum(EffectiveCost) AS DOUBLE) AS EffectiveCost
FROM offers WHERE {scope} GROUP BY {keys}"""


SQL |= {
    "op_sku_prefix_eligible_all": catalog("x_SkuDescription"),
    "op_eligible_services_all": catalog("ServiceName, ServiceCategory"),
    "op_compute_services_all": catalog(
        "ServiceName, ServiceCategory",
        f"ServiceName IN ({quoted(COMPUTE_NAMES)}) OR ServiceCategory IN ({quoted(COMPUTE_CATEGORIES)})",
    ),
}
