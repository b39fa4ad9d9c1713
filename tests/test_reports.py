"""Properties that hold between the columns of a report and between reports."""

import datetime as dt
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from commitlens.operators.scope import since
from commitlens.plans import REPORTS, opportunity, savings, sizing
from commitlens.sources.fixture import AS_OF

AS_OF_DATE = dt.date.fromisoformat(AS_OF)


@pytest.fixture(scope="module")
def stored(spark, stored_charges):
    return spark.read.parquet(stored_charges)


@pytest.fixture(scope="module")
def rows(stored):
    """Rows of a report, computed once."""
    known = {}

    def compute(key):
        if key not in known:
            known[key] = [r.asDict() for r in REPORTS[key](stored, AS_OF_DATE).collect()]
        return known[key]

    return compute


def test_covered_and_uncovered_make_the_total(rows):
    for key in ("q02_coverage_summary", "q03_coverage_by_service", "q10_eligible_coverage"):
        for r in rows(key):
            parts = r["CoveredEffectiveCost"] + r["UncoveredEffectiveCost"]
            assert math.isclose(parts, r["TotalEffectiveCost"], rel_tol=1e-12)
    for r in rows("q02_coverage_summary"):
        assert math.isclose(r["CoverageRatePct"] + r["UncoveredRatePct"], 100.0)


def test_shares_of_a_service_category_sum_to_100(rows):
    shares, totals = defaultdict(list), defaultdict(float)
    for r in rows("q04_coverage_by_pricing_category"):
        group = r["ProviderName"], r["ServiceCategory"]
        shares[group].append(r["PctOfServiceSpend"])
        totals[group] += r["TotalEffectiveCost"]
    assert any(total == 0 for total in totals.values())
    for group, parts in shares.items():
        if totals[group] == 0:
            assert parts == [None] * len(parts)
        else:
            assert math.isclose(sum(parts), 100.0)


def test_pricing_category_null_is_a_group(rows):
    assert {r["PricingCategory"] for r in rows("q04_coverage_by_pricing_category")} >= {
        None, "Committed", "Standard", "Dynamic",
    }


def test_month_groups_are_among_the_groups_since_october(rows):
    def groups(key):
        return {(r["ProviderName"], r["ServiceCategory"], r["ServiceName"]) for r in rows(key)}

    assert groups("q10c_eligible_coverage_month") <= groups("q10b_eligible_coverage_since")
    assert groups("q10_eligible_coverage") < groups("q03_coverage_by_service")


def test_percentiles_rise(rows):
    (sized,) = rows("q15_savings_plan_sizing")
    for side in ("Total", "Uncovered"):
        points = [sized[f"{side}_{p}Daily"] for p in ("Min", "P10_", "P25_", "P50_", "P75_", "P90_", "Max")]
        assert points == sorted(points)
        assert points[0] <= sized[f"{side}_AvgDaily"] <= points[-1]
    for r in rows("q17_storage_reservations"):
        points = [r[f"Uncovered_{p}Daily"] for p in ("Min", "P25_", "P50_", "P75_", "Max")]
        assert points == sorted(points)


def test_storage_leaves_bandwidth_out_and_keeps_unnamed_types(rows):
    kinds = {(r["StorageType"], r["IsCapacityCharge"]) for r in rows("q17_storage_reservations")}
    assert "Bandwidth" not in {kind for kind, _ in kinds}
    assert (None, "No") in kinds and (None, "Yes") not in kinds


ORDER = {
    "q01_service_savings": "TotalSavingsRealized",
    "q02_coverage_summary": "TotalEffectiveCost",
    "q03_coverage_by_service": "TotalEffectiveCost",
    "q05_commitment_utilization": "TotalSavings",
    "q06_savings_by_type": "TotalSavings",
    "q08_top_services_3mo": "Total3MonthEffectiveCost",
    "q09_active_commitments": "TotalSavings",
    "q10_eligible_coverage": "TotalEffectiveCost",
    "q10b_eligible_coverage_since": "TotalEffectiveCost",
    "q10c_eligible_coverage_month": "TotalEffectiveCost",
    "q11_commitment_details": "TotalSavings",
    "q12_savings_opportunity": "TotalUncoveredCost",
    "q13_hourly_spend": "TotalUncoveredCost",
    "q14_covered_skus": "TotalEffectiveCost",
    "q17_storage_reservations": "Uncovered_EffectiveCost",
}


@pytest.mark.parametrize("key", ORDER)
def test_reports_are_in_falling_order(rows, key):
    found = [r[ORDER[key]] for r in rows(key)]
    assert found and found == sorted(found, key=lambda v: (v is not None, v or 0), reverse=True)


def test_orders_of_several_columns(rows):
    trend = [
        (r["UsageDate"], r["DailySavings"] is not None, r["DailySavings"] or 0)
        for r in rows("q07_daily_trend")
    ]
    assert trend == sorted(trend, reverse=True)
    shares = [
        (r["ProviderName"] or "", r["ServiceCategory"], r["TotalEffectiveCost"] is None, -(r["TotalEffectiveCost"] or 0))
        for r in rows("q04_coverage_by_pricing_category")
    ]
    assert shares == sorted(shares)


def test_rolling_reports_default_to_the_current_date(spark, stored):
    """Without an as-of date the window ends today; the fixture lies before it or not at all."""
    today = dt.date.today()
    report = REPORTS["q02_coverage_summary"]
    assert report(stored).collect() == report(stored, today).collect()


def test_three_months_want_ninety_days(stored):
    with pytest.raises(ValueError, match="90"):
        savings.top_services(stored, since("2025-10-01"))


def test_discounts_are_parameters(stored):
    usual = {tuple(r)[:4]: r for r in opportunity.savings_opportunity(stored).collect()}
    for r in opportunity.savings_opportunity(stored, discounts=(0.5, 0.75)).collect():
        assert r.EstimatedSavings25Pct == pytest.approx(2 * usual[tuple(r)[:4]].EstimatedSavings25Pct)
        assert r.EstimatedSavings30Pct == pytest.approx(2.5 * usual[tuple(r)[:4]].EstimatedSavings30Pct)
    plan, half = (sizing.savings_plan_sizing(stored, discount=d).first() for d in (0.25, 0.125))
    assert half.Total_P50_EstimatedAnnualSavings == pytest.approx(plan.Total_P50_EstimatedAnnualSavings / 2)
    usual = {tuple(r)[:3]: r for r in sizing.storage_reservations(stored).collect()}
    for r in sizing.storage_reservations(stored, discounts=(0.5, 0.19)).collect():
        assert r.EstSavings_1yr_25pct == pytest.approx(2 * usual[tuple(r)[:3]].EstSavings_1yr_25pct)
        assert r.EstSavings_3yr_38pct == pytest.approx(usual[tuple(r)[:3]].EstSavings_3yr_38pct / 2)
