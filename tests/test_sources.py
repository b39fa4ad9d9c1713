"""Reading charge tables from files and catalogs."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from rows import charge_table

from commitlens.operators.scope import between, charge_window, last_days, since
from commitlens.plans import REPORTS
from commitlens.schema import ChargeSchemaError, conform
from commitlens.sources.charges import read_charges


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def by_month(spark, stored_charges, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("months") / "focus")
    spark.read.parquet(stored_charges).withColumn(
        "charge_month", F.trunc("ChargePeriodStart", "MM")
    ).repartition("charge_month").write.partitionBy("charge_month").parquet(path)
    return path


def test_reads_files_and_tables(spark, stored_charges):
    from_path = read_charges(spark, path=stored_charges)
    from_path.createOrReplaceTempView("focus_view")
    from_table = read_charges(spark, table="focus_view")
    assert from_path.schema == from_table.schema
    assert from_path.count() == from_table.count() == 60_000


def test_wants_a_path_or_a_table(spark):
    with pytest.raises(ValueError):
        read_charges(spark)
    with pytest.raises(ValueError):
        read_charges(spark, path="p", table="t")


def test_missing_columns_are_named(spark):
    charges = charge_table(spark, {}).drop("RegionId", "ListCost")
    with pytest.raises(ChargeSchemaError, match="RegionId.*ListCost"):
        conform(charges)
    assert conform(charges, ["ServiceName"]).columns == ["ServiceName"]


def test_times_must_be_times(spark):
    charges = charge_table(spark, {}).withColumn("ChargePeriodStart", F.lit(20260101))
    with pytest.raises(ChargeSchemaError, match="ChargePeriodStart"):
        conform(charges)


def test_measures_are_not_rounded_and_times_stay(spark):
    charges = (
        charge_table(spark, {"EffectiveCost": 1.25})
        .withColumn("EffectiveCost", F.lit(0.0000004))
        .withColumn("ListCost", F.lit("0.000000000000000004").cast("decimal(38,20)"))
        .withColumn("PricingQuantity", F.lit(3))
        .withColumn("ChargePeriodStart", F.col("ChargePeriodStart").cast("timestamp"))
        .withColumn("ChargePeriodEnd", F.lit(dt.date(2026, 3, 2)))
    )
    kept = conform(charges)
    types = dict(kept.dtypes)
    assert types["EffectiveCost"] == types["PricingQuantity"] == "decimal(38,18)"
    assert types["ListCost"] == "decimal(38,20)" and types["ContractedCost"] == "decimal(18,6)"
    assert types["ChargePeriodStart"] == "timestamp" and types["ChargePeriodEnd"] == "date"
    row = kept.first()
    assert row.EffectiveCost == Decimal("0.0000004") and row.ListCost == Decimal("4E-18")


@pytest.mark.parametrize("stored", ["double", "decimal(38,18)"])
def test_many_small_charges_add_up(spark, tmp_path, stored):
    one = charge_table(spark, {}).withColumns(
        {"PricingQuantity": F.lit(0.0033).cast(stored), "EffectiveCost": F.lit(0.0000004).cast(stored)}
    )
    one.crossJoin(spark.range(1000)).drop("id").write.parquet(f"{tmp_path}/small")
    sums = read_charges(spark, path=f"{tmp_path}/small").agg(F.sum("PricingQuantity"), F.sum("EffectiveCost")).first()
    assert tuple(sums) == (Decimal("3.3"), Decimal("0.0004"))


def test_a_zone_other_than_utc_is_refused(spark):
    charges = charge_table(spark, {}).withColumn("ChargePeriodStart", F.col("ChargePeriodStart").cast("timestamp"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ChargeSchemaError, match="UTC"):
            conform(charges)
        conform(charge_table(spark, {}))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("file_format", ["csv", "json", "orc"])
def test_every_format_gives_the_same_reports(spark, stored_charges, tmp_path, file_format):
    plain = read_charges(spark, path=stored_charges)
    out = plain.select("*") if file_format == "orc" else plain.select(*[F.col(c).cast("string") for c in plain.columns])
    writer = out.write.format(file_format)
    if file_format == "csv":
        writer = writer.option("header", "true").option("sep", ";")
    writer.save(f"{tmp_path}/charges")
    options = {"sep": ";"} if file_format == "csv" else None
    read = read_charges(spark, path=f"{tmp_path}/charges", file_format=file_format, options=options)
    as_of = dt.date(2026, 3, 16)
    for key, report in REPORTS.items():
        assert sorted(map(str, report(read, as_of).collect())) == sorted(map(str, report(plain, as_of).collect())), key


def test_zoned_timestamps_give_the_same_report(spark, stored_charges):
    plain = read_charges(spark, path=stored_charges)
    zoned = plain.withColumn("ChargePeriodStart", F.col("ChargePeriodStart").cast("timestamp"))
    report = REPORTS["q16_sizing_validation"]
    assert report(zoned).collect() == report(plain).collect()


@pytest.mark.parametrize(
    ("window", "months"),
    [
        (since("2025-10-01"), 6),
        (between("2026-01-01", "2026-02-01"), 1),
        (between("2026-01-15", "2026-02-02"), 2),
        (last_days(30, dt.date(2026, 3, 16)), 2),
    ],
)
def test_month_partitions_outside_the_window_are_not_read(spark, stored_charges, by_month, window, months):
    pruned = charge_window(read_charges(spark, path=by_month, month_column="charge_month"), window)
    scanned = pruned.select(F.input_file_name().alias("f")).distinct()
    assert scanned.count() == months
    assert "PartitionFilters: [isnotnull(charge_month" in plan(pruned)
    whole = charge_window(read_charges(spark, path=stored_charges), window)
    assert pruned.count() == whole.count()


def test_reports_prune_by_their_own_window(spark, stored_charges, by_month):
    as_of = dt.date(2026, 3, 16)
    whole, monthly = read_charges(spark, path=stored_charges), read_charges(spark, path=by_month, month_column="charge_month")
    for key, report in REPORTS.items():
        pruned = report(monthly, as_of)
        assert "PartitionFilters: [isnotnull(charge_month" in plan(pruned), key
        assert sorted(map(str, pruned.collect())) == sorted(map(str, report(whole, as_of).collect())), key


def test_current_date_window_prunes_too(spark, by_month):
    pruned = charge_window(read_charges(spark, path=by_month, month_column="charge_month"), last_days(30))
    assert "PartitionFilters: [isnotnull(charge_month" in plan(pruned)
