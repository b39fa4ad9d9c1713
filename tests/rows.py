"""Charge tables of a few literal rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from commitlens.schema import CHARGE_COLUMNS, CHARGE_SCHEMA

_DEFAULTS = {
    "ProviderName": "P",
    "ServiceCategory": "Compute",
    "ServiceName": "Virtual Machines",
    "ChargeCategory": "Usage",
    "ListCost": 10,
    "EffectiveCost": 8,
    "ContractedCost": 9,
    "PricingQuantity": 1,
    "ChargePeriodStart": "2026-03-01",
}


def moment(text: str | None) -> dt.datetime | None:
    return None if text is None else dt.datetime.fromisoformat(text)


def charge_table(spark, *rows: dict):
    """Charges with the given columns; the others are ordinary usage, or NULL."""

    def value(name: str, row: dict):
        v = row.get(name, _DEFAULTS.get(name))
        if v is None or isinstance(v, dt.datetime):
            return v
        if name.startswith("ChargePeriod"):
            return moment(v)
        return Decimal(str(v)) if name.endswith(("Cost", "Quantity")) else v

    data = [tuple(value(name, {**_DEFAULTS, **row}) for name in CHARGE_COLUMNS) for row in rows]
    return spark.createDataFrame(data, CHARGE_SCHEMA)


def values(df, column: str) -> list:
    return sorted((row[column] for row in df.collect()), key=lambda v: (v is not None, v))
