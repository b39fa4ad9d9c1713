"""A deterministic charge table derived from order lines, for tests and benchmarks.

Each order line becomes one charge. The line's keys pick its day, SKU, commitment and charge
class, so every business state the reports tell apart occurs at every scale factor.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.catalogs import COMPUTE_PLAN_SKU_PREFIXES, ELIGIBLE_CATEGORIES, service_names
from commitlens.schema import CHARGE_COLUMNS
from commitlens.session import shared_folder
from commitlens.sources.charges import read_charges

_COSTS = ("ListCost", "ContractedCost", "EffectiveCost")

FIRST_DAY = "2025-02-15"
AS_OF = "2026-03-16"

# Ix, service category, service, meter category, meter subcategory, text, cost factor.
SKU_CATALOG = [
    (0, "Compute", "Virtual Machines", "Virtual Machines", "Dadsv5 Series", "Virtual Machines Dadsv5 Series - D16ads v5 - US East", 1),
    (1, "Compute", "Virtual Machines", "Virtual Machines", "Dv3/DSv3 Series", "Virtual Machines Dv3/DSv3 Series - D4 v3 - US West", 1),
    (2, "Compute", "Virtual Machines", "Virtual Machines", "Qsv9 Series", "Virtual Machines Qsv9 Series - Q2 - US East", 1),
    (3, "Compute", "Azure Dedicated Host", "Virtual Machines", "DSv3 Dedicated Host", "DSv3 Series Dedicated Host - Type1", 1),
    (4, "Compute", "Azure Functions", "Functions", "Premium Functions", "Premium Functions - vCPU Duration", 1),
    (5, "Compute", "Batch Helper", "Batch", None, "batch helper node", 1),
    (6, "Web", "Azure App Service", "Azure App Service", "Premium v3 Plan", "Azure App Service Premium v3 Plan - P1 v3", 1),
    (7, "Web", "App Service", "Azure App Service", "Basic Plan", "App Service Basic Plan - B1", 1),
    (8, "Databases", "Azure SQL Database", "SQL Database", "Single", "SQL Database Single - vCore", 1),
    (9, "Databases", "Odd Database", "Odd DB", "Odd", "Odd Database - vCore", 1),
    (10, "Storage", "Storage", "Storage", "Premium SSD Managed Disks", "Premium SSD Managed Disks - P30 LRS Disk", 1),
    (11, "Storage", "Storage", "Storage", "Premium SSD Managed Disks", "Premium SSD Managed Disks - P20 LRS Disk", 1),
    (12, "Storage", "Storage", "Storage", "Premium SSD Managed Disks", "Premium SSD Managed Disks - P60", 1),
    (13, "Storage", "Storage", "Storage", "Ultra Disks", "Ultra Disks - Provisioned Capacity", 1),
    (14, "Storage", "Storage", "Storage", "Ultra Disks", "Ultra Disks - Provisioned IOPS", 1),
    (15, "Storage", "Storage", "Storage", "Tiered Block Blob", "Tiered Block Blob - Hot LRS Data Stored", 1),
    (16, "Storage", "Storage", "Storage", "Tiered Block Blob", "Tiered Block Blob - Hot Write Operations", 1),
    (17, "Storage", "Azure Files", "Storage", "Files", "Files - LRS Data Stored", 1),
    (18, "Storage", "Azure Files", "Storage", "Files v2", "Files v2 - Hot Data Stored", 1),
    (19, "Storage", "Azure Files", "Storage", "Files v2", "Files v2 - Read Operations", 1),
    (20, "Storage", "Azure NetApp Files", "Storage", "Azure NetApp Files", "Azure NetApp Files - Standard Capacity", 1),
    (21, "Storage", "Azure NetApp Files", "Storage", "Azure NetApp Files", "Azure NetApp Files - Snapshots", 1),
    (22, "Storage", "Azure NetApp Files", "Storage", "Azure NetApp Files", None, 1),
    (23, "Storage", "Azure Backup", "Storage", "Backup", "Backup - GRS Data Stored", 1),
    (24, "Storage", "Storage", "Storage", "Bandwidth", "Bandwidth - Data Stored out", 1),
    (25, "Storage", "Storage", "Storage", None, "Storage - Data Stored", 1),
    (26, "Networking", "ExpressRoute", "ExpressRoute", "Metered", "ExpressRoute - Circuit", 1),
    (27, "Networking", "Load Balancer", "Load Balancer", "Standard", "Load Balancer - Rules", 1),
    (28, "Security", "Microsoft Sentinel", "Sentinel", "Analysis", "Microsoft Sentinel - Analysis", 1),
    (29, "Other", "Free Service", "Free", "Free", "Free tier", 0),
    (30, "Other Credits", "Refunds", "Refunds", "Refund", "Refund adjustment", -1),
    (31, "AI and Machine Learning", "Odd AI", "Odd AI", "Tokens", "virtual machines dadsv5 series lower case", 1),
]

_CATALOG_COLUMNS = "ix, category, service, meter, submeter, text, mult"


def sku_catalog_values() -> str:
    """The catalog as a SQL ``VALUES`` list."""

    def literal(value: int | str | None) -> str:
        if value is None:
            return "NULL"
        return f"'{value}'" if isinstance(value, str) else str(value)

    return ", ".join(f"({', '.join(map(literal, row))})" for row in SKU_CATALOG)


def sku_catalog(spark: SparkSession) -> DataFrame:
    """The 32 catalog rows as an inline table, small enough by its statistics to be broadcast."""
    return spark.sql(f"SELECT * FROM VALUES {sku_catalog_values()} AS sku({_CATALOG_COLUMNS})")


# Columns read from each source table.
_TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
}

# What the rules below refer to: the day, and the buckets that pick commitment and category.
_DERIVED = {
    "d": "cast((l_orderkey * 7 + l_partkey * 3 + l_linenumber * 13) % 400 as int)",
    "k": "(l_orderkey + l_suppkey * 3) % 10",
    "plan": "l_suppkey % 7",
    "kind": "(l_linenumber + l_suppkey) % 11",
    "listed": "cast(cast(l_extendedprice as decimal(12,2)) * mult as decimal(18,6))",
    "day0": f"cast(date '{FIRST_DAY}' as timestamp_ntz)",
}

_RULES = {
    "ProviderName": "case when l_suppkey % 8 = 0 then 'Marketplace' when l_suppkey % 50 <> 49 then 'Microsoft' end",
    "ServiceCategory": "category",
    "ServiceName": "service",
    "RegionId": "if(s_nationkey <> 24, lower(n_name), null)",
    "RegionName": "if(s_nationkey <> 24, if(l_linenumber = 7, 'Old ', '') || n_name, null)",
    "ListCost": "if(l_partkey % 89 = 0, null, listed)",
    "ContractedCost": "cast(listed * (1 - cast(l_tax as decimal(4,2))) as decimal(18,6))",
    "EffectiveCost": "if(l_orderkey % 97 = 0, null, cast(listed * (1 - cast(l_discount as decimal(4,2)))"
    " * if(k <= 2, 0.6, 1.0) as decimal(18,6)))",
    "PricingQuantity": "cast(cast(l_quantity as decimal(12,2)) * 0.0033 as decimal(18,6))",
    "CommitmentDiscountId": "if(k <= 2, 'cd-' || plan, null)",
    "CommitmentDiscountName": "if(k <= 1, 'Commit ' || plan, null)",
    "CommitmentDiscountType": "if(k <= 2, if(plan % 2 = 0, 'Reservation', 'Savings Plan'), null)",
    "ResourceId": "if(o_custkey % 50 <> 0, 'res-' || o_custkey % 500, null)",
    "ChargeCategory": "case when l_orderkey % 101 = 0 then null when kind = 0 then 'Purchase'"
    " when kind = 1 then 'Tax' else 'Usage' end",
    "ChargeClass": "case when l_returnflag = 'R' and l_linenumber = 1 then 'Correction'"
    " when l_returnflag = 'A' then 'Regular' end",
    "ChargePeriodStart": "day0 + make_dt_interval(d, if(l_linenumber % 2 = 1, 6, 0))",
    "ChargePeriodEnd": "day0 + make_dt_interval(d + 1)",
    "PricingCategory": "case when k <= 1 then 'Committed' when k = 3 then null"
    " when k = 4 then 'Dynamic' else 'Standard' end",
    "ChargeDescription": "'Charge: ' || text || ' per hour'",
    "SkuId": "'SKU-' || ix",
    "SkuPriceId": "'SKU-' || ix || '-' || l_suppkey % 3",
    "x_SkuDescription": "text",
    "x_SkuMeterCategory": "meter",
    "x_SkuMeterSubcategory": "submeter",
}


SMALL = "0.0000000001"


def stored_small_charges(spark: SparkSession, sf_dir: str, measures: str) -> DataFrame:
    """The fixture with costs by 10**-10, written with ``measures`` as that type and read as a table is."""
    costs = [F.expr(f"cast({c} * cast({SMALL} as decimal(10,10)) as decimal(38,18))").cast(measures).alias(c) for c in _COSTS]
    others = [c for c in CHARGE_COLUMNS if c not in (*_COSTS, "PricingQuantity")]
    small = fixture_charges(spark, sf_dir).select(*others, *costs, F.col("PricingQuantity").cast(measures))
    path = f"{shared_folder(spark)}/charges-{uuid.uuid4().hex}"
    small.write.parquet(path)
    return read_charges(spark, path=path)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A charge for each order line, so that every catalog entry is some line's SKU, service or category."""

    def entry(values: Sequence[str], key: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))

    lines = spark.read.schema(_TABLES["lineitem"]).parquet(f"{sf_dir}/lineitem.parquet")
    by_name = F.col("l_linenumber") % 2 == 0
    none = F.lit("None")
    return lines.select(
        F.concat(entry(COMPUTE_PLAN_SKU_PREFIXES, "l_partkey"), F.lit(" - "), "l_linenumber").alias("x_SkuDescription"),
        F.when(by_name, entry(service_names(), "l_partkey")).otherwise(none).alias("ServiceName"),
        F.when(by_name, none).otherwise(entry(ELIGIBLE_CATEGORIES, "l_partkey")).alias("ServiceCategory"),
        F.col("l_extendedprice").cast("decimal(18,6)").alias("EffectiveCost"),
    )


def fixture_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges derived from the lineitem, orders, supplier and nation tables under ``sf_dir``.

    How each table is joined is left to its statistics: small ones are broadcast, large ones
    shuffled on the key.
    """
    lines, orders, suppliers, nations = (
        spark.read.schema(columns).parquet(f"{sf_dir}/{name}.parquet")
        for name, columns in _TABLES.items()
    )
    return (
        lines.join(orders, F.expr("l_orderkey = o_orderkey"))
        .join(suppliers, F.expr("l_suppkey = s_suppkey"))
        .join(nations, F.expr("s_nationkey = n_nationkey"))
        .join(sku_catalog(spark), F.expr("l_partkey % 32 = ix"))
        .selectExpr("*", *[f"{rule} as {name}" for name, rule in _DERIVED.items()])
        .selectExpr(*[f"{_RULES[name]} as {name}" for name in CHARGE_COLUMNS])
    )
