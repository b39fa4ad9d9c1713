"""The fixture charge table as a DuckDB common table expression."""

from commitlens.sources.fixture import FIRST_DAY, sku_catalog_values

FOCUS = f"""
sku(ix, category, service, meter, submeter, text, mult) AS (VALUES {sku_catalog_values()}),
lines AS (
    SELECT *,
        (l_orderkey * 7 + l_partkey * 3 + l_linenumber * 13) % 400 AS d,
        (l_orderkey + l_suppkey * 3) % 10 AS k,
        (l_linenumber + l_suppkey) % 11 AS kind,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * mult AS DECIMAL(18,6)) AS listed
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
    JOIN sku ON l_partkey % 32 = ix
),
focus AS (
    SELECT
        CASE WHEN l_suppkey % 8 = 0 THEN 'Marketplace'
            WHEN l_suppkey % 50 <> 49 THEN 'Microsoft' END AS ProviderName,
        category AS ServiceCategory,
        service AS ServiceName,
        CASE WHEN s_nationkey <> 24 THEN lower(n_name) END AS RegionId,
        CASE WHEN s_nationkey <> 24 THEN
            CASE WHEN l_linenumber = 7 THEN 'Old ' ELSE '' END || n_name END AS RegionName,
        CASE WHEN l_partkey % 89 <> 0 THEN listed END AS ListCost,
        CASE WHEN l_orderkey % 97 <> 0 THEN CAST(listed * (1 - CAST(l_discount AS DECIMAL(4,2)))
            * CASE WHEN k <= 2 THEN 0.6 ELSE 1.0 END AS DECIMAL(18,6)) END AS EffectiveCost,
        CAST(listed * (1 - CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,6)) AS ContractedCost,
        CAST(CAST(l_quantity AS DECIMAL(12,2)) * 0.0033 AS DECIMAL(18,6)) AS PricingQuantity,
        CASE WHEN k <= 2 THEN 'cd-' || (l_suppkey % 7) END AS CommitmentDiscountId,
        CASE WHEN k <= 1 THEN 'Commit ' || (l_suppkey % 7) END AS CommitmentDiscountName,
        CASE WHEN k <= 2 THEN CASE WHEN l_suppkey % 7 % 2 = 0 THEN 'Reservation'
            ELSE 'Savings Plan' END END AS CommitmentDiscountType,
        CASE WHEN k <= 1 THEN 'Committed' WHEN k = 3 THEN NULL WHEN k = 4 THEN 'Dynamic'
            ELSE 'Standard' END AS PricingCategory,
        CASE WHEN o_custkey % 50 <> 0 THEN 'res-' || (o_custkey % 500) END AS ResourceId,
        CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN kind = 0 THEN 'Purchase'
            WHEN kind = 1 THEN 'Tax' ELSE 'Usage' END AS ChargeCategory,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'Correction'
            WHEN l_returnflag = 'A' THEN 'Regular' END AS ChargeClass,
        TIMESTAMP '{FIRST_DAY}' + INTERVAL 1 DAY * d
            + INTERVAL 1 HOUR * CASE WHEN l_linenumber % 2 = 1 THEN 6 ELSE 0 END
            AS ChargePeriodStart,
        TIMESTAMP '{FIRST_DAY}' + INTERVAL 1 DAY * (d + 1) AS ChargePeriodEnd,
        'Charge: ' || text || ' per hour' AS ChargeDescription,
        'SKU-' || ix AS SkuId,
        'SKU-' || ix || '-' || (l_suppkey % 3) AS SkuPriceId,
        text AS x_SkuDescription,
        meter AS x_SkuMeterCategory,
        submeter AS x_SkuMeterSubcategory
    FROM lines
)"""


# The fixture as a table of very small charges: costs by 10**-10, all digits kept.
_SMALL = ", ".join(
    f"CAST(CAST({c} AS DECIMAL(22,6)) * 0.0000000001 AS DECIMAL(38,18)) AS {c}"
    for c in ("ListCost", "EffectiveCost", "ContractedCost")
)


def small(query: str) -> str:
    """``query``, made by ``with_focus``, over the small charges instead."""
    whole = FOCUS.strip()
    renamed = whole.replace("\nfocus AS (", "\nfocus_whole AS (")
    return query.replace(whole, f"{renamed},\nfocus AS (SELECT * REPLACE ({_SMALL}) FROM focus_whole)")


def with_focus(query: str) -> str:
    """``query`` over the fixture; it may begin with further table expressions (``name AS (...)``)."""
    query = query.strip()
    joint = "\n" if query.upper().startswith("SELECT") else ",\n"
    return f"WITH {FOCUS.strip()}{joint}{query}"
