"""The derived charge table has the rows and states it promises."""

from pyspark.sql import functions as F

from commitlens.schema import CHARGE_SCHEMA


def test_schema(charges):
    assert [(f.name, f.dataType) for f in charges.schema] == [
        (f.name, f.dataType) for f in CHARGE_SCHEMA
    ]


def test_counts(charges):
    counts = charges.agg(
        F.count("*"),
        F.countDistinct(F.to_date("ChargePeriodStart")),
        F.countDistinct("RegionId"),
        F.countDistinct("ResourceId"),
        F.countDistinct("ServiceName"),
        F.min("ChargePeriodStart").cast("string"),
        F.max("ChargePeriodStart").cast("string"),
    ).first()
    assert tuple(counts) == (60_000, 400, 24, 490, 18, "2025-02-15 00:00:00", "2026-03-21 06:00:00")


def test_charge_classes(charges):
    rows = charges.groupBy("ChargeCategory", "ChargeClass").count().collect()
    found = {(r.ChargeCategory, r.ChargeClass): r["count"] for r in rows}
    assert found["Usage", "Correction"] == 2_270
    assert found["Usage", "Regular"] == 16_291
    assert found["Usage", None] == 30_063
    assert sum(n for (category, _), n in found.items() if category == "Purchase") == 5_444
    assert sum(n for (category, _), n in found.items() if category == "Tax") == 5_344


def test_coverage_marks_disagree(charges):
    rows = (
        charges.groupBy(
            "PricingCategory",
            F.col("CommitmentDiscountId").isNotNull().alias("id"),
            F.col("CommitmentDiscountName").isNotNull().alias("name"),
        )
        .count()
        .collect()
    )
    assert {(r.PricingCategory, r.id, r.name): r["count"] for r in rows} == {
        ("Committed", True, True): 11_890,
        ("Standard", True, False): 6_040,
        ("Standard", False, False): 30_046,
        ("Dynamic", False, False): 5_975,
        (None, False, False): 6_049,
    }
