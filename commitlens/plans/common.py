"""What the reports share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from commitlens.operators.scope import ChargeWindow, charge_window, since, usage_scope

SINCE_OCTOBER = since("2025-10-01")

SERVICE = ["ProviderName", "ServiceCategory", "ServiceName"]
COMMITMENT = [
    "ProviderName",
    "CommitmentDiscountId",
    "CommitmentDiscountName",
    "CommitmentDiscountType",
]


def usage_in(charges: DataFrame, window: ChargeWindow) -> DataFrame:
    return charges.transform(usage_scope).transform(charge_window, window)
