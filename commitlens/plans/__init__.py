"""The nineteen commitment reports.

Each report is a function of a charge table and a window and returns a lazy DataFrame. Reports
with a rolling window look back from the date the query runs unless they are given another window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from commitlens.operators.scope import ChargeWindow, last_days
from commitlens.plans import commitments, coverage, opportunity, savings, sizing
from commitlens.plans.common import SINCE_OCTOBER


@dataclass(frozen=True)
class Report:
    compute: Callable[..., DataFrame]
    window: ChargeWindow | None = None
    lookback_days: int | None = None

    def window_as_of(self, as_of: dt.date | None = None) -> ChargeWindow:
        return self.window or last_days(self.lookback_days, as_of)

    def __call__(self, charges: DataFrame, as_of: dt.date | None = None) -> DataFrame:
        return self.compute(charges, self.window_as_of(as_of))


def _rolling(compute: Callable[..., DataFrame], days: int) -> Report:
    return Report(compute, lookback_days=days)


REPORTS = {
    "q01_service_savings": _rolling(savings.service_savings, 30),
    "q02_coverage_summary": _rolling(coverage.coverage_summary, 30),
    "q03_coverage_by_service": _rolling(coverage.coverage_by_service, 30),
    "q04_coverage_by_pricing_category": _rolling(savings.coverage_by_pricing_category, 30),
    "q05_commitment_utilization": _rolling(commitments.commitment_utilization, 30),
    "q06_savings_by_type": _rolling(commitments.savings_by_type, 30),
    "q07_daily_trend": _rolling(commitments.daily_trend, 30),
    "q08_top_services_3mo": _rolling(savings.top_services, 90),
    "q09_active_commitments": Report(commitments.active_commitments, SINCE_OCTOBER),
    "q10_eligible_coverage": _rolling(coverage.eligible_coverage, 30),
    "q10b_eligible_coverage_since": Report(coverage.eligible_coverage, SINCE_OCTOBER),
    "q10c_eligible_coverage_month": Report(coverage.eligible_coverage, coverage.ELIGIBLE_MONTH),
    "q11_commitment_details": Report(commitments.commitment_details, SINCE_OCTOBER),
    "q12_savings_opportunity": Report(opportunity.savings_opportunity, SINCE_OCTOBER),
    "q13_hourly_spend": Report(opportunity.hourly_spend, SINCE_OCTOBER),
    "q14_covered_skus": Report(commitments.covered_skus, SINCE_OCTOBER),
    "q15_savings_plan_sizing": Report(sizing.savings_plan_sizing, sizing.SINCE_MARCH),
    "q16_sizing_validation": Report(sizing.sizing_validation, SINCE_OCTOBER),
    "q17_storage_reservations": Report(sizing.storage_reservations, sizing.SINCE_MARCH),
}
