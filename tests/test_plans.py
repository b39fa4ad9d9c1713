"""What the physical plans must and must not hold, for a charge table read from files."""

import datetime as dt
import re

import pytest

from commitlens.plans import REPORTS
from commitlens.sources.charges import read_charges
from commitlens.sources.fixture import AS_OF


def leaf_scan(df):
    """The file scan of an executed plan."""
    node = df._jdf.queryExecution().sparkPlan()
    while not node.nodeName().startswith("Scan parquet"):
        node = node.children().head()
    return node


@pytest.fixture(scope="module")
def planned(spark, stored_charges):
    charges = read_charges(spark, path=stored_charges)
    known = {}

    def of(key):
        if key not in known:
            report = REPORTS[key](charges, dt.date.fromisoformat(AS_OF))
            known[key] = report, report._jdf.queryExecution().executedPlan().toString()
        return known[key]

    return of


@pytest.mark.parametrize("key", REPORTS)
def test_one_scan_no_python_no_join(planned, key):
    _, plan = planned(key)
    assert plan.count("FileScan parquet") == 1
    assert not re.search(r"Python|ArrowEval|MapInPandas|Join|Cartesian|SortAggregate", plan)


@pytest.mark.parametrize("key", REPORTS)
def test_scope_and_window_reach_the_scan(planned, key):
    report, _ = planned(key)
    pushed = leaf_scan(report).metadata().get("PushedFilters").get()
    filters = leaf_scan(report).dataFilters().mkString(" ; ")
    assert re.search(r"ChargePeriodStart#\d+ >= ", filters)
    assert "ChargeClass" in filters
    assert ("(ChargeCategory" in filters) == (key != "q11_commitment_details")
    assert "IsNotNull(ChargePeriodStart)" in pushed


@pytest.mark.parametrize("key", REPORTS)
def test_only_needed_columns_are_read(planned, key):
    report, _ = planned(key)
    read = set(leaf_scan(report).requiredSchema().fieldNames())
    assert len(read) <= 16
    assert ("ResourceId" in read) == any("Resource" in c for c in report.columns)
    assert ("x_SkuDescription" in read) == (key == "q15_savings_plan_sizing")


@pytest.mark.parametrize("key", REPORTS)
def test_rows_are_combined_before_every_shuffle(planned, key):
    """No shuffle carries charges: each one stands on an aggregation of its input."""
    _, plan = planned(key)
    lines = plan.splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert shuffles
    for i in shuffles:
        below = "\n".join(lines[i + 1 :])
        first = re.search(r"(HashAggregate|ObjectHashAggregate|Window|Expand|FileScan)", below)
        assert first.group(1) not in ("Expand", "FileScan")


@pytest.mark.parametrize(
    "key",
    ["q02_coverage_summary", "q03_coverage_by_service", "q10_eligible_coverage"],
)
def test_resource_coverage_does_not_copy_charges(planned, key):
    assert "Expand" not in planned(key)[1]


@pytest.mark.parametrize("key", [k for k in REPORTS if k.startswith("q10")])
def test_eligible_coverage_shuffles_twice(planned, key):
    assert planned(key)[1].count("Exchange hashpartitioning") == 2
