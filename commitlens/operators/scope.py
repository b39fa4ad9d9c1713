"""Row scopes: which charges a report looks at.

Every predicate is on a stored column as it is, so that it reaches the file scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.schema import MONTH


@dataclass(frozen=True)
class ChargeWindow:
    """Charge period starts from ``start`` on and, where ``end`` is set, before ``end``.

    ``start`` is a date, or a number of days before the current date; ``lookback`` is the number of
    days of a window that was made by looking back.
    """

    start: dt.date | int | None = None
    end: dt.date | None = None
    lookback: int | None = None

    def start_date(self) -> Column:
        if isinstance(self.start, int):
            return F.date_sub(F.current_date(), self.start)
        return F.lit(self.start)

    def end_date(self) -> Column:
        return F.lit(self.end)


def last_days(days: int, as_of: dt.date | None = None) -> ChargeWindow:
    """From midnight ``days`` before ``as_of``, by default the date the query runs."""
    return ChargeWindow(days if as_of is None else as_of - dt.timedelta(days=days), lookback=days)


def since(start: str) -> ChargeWindow:
    return ChargeWindow(dt.date.fromisoformat(start))


def between(start: str, end: str) -> ChargeWindow:
    return ChargeWindow(dt.date.fromisoformat(start), dt.date.fromisoformat(end))


def charge_window(charges: DataFrame, window: ChargeWindow) -> DataFrame:
    """Charges whose period starts within ``window``.

    A table read with its month partition is filtered by that as well, by the same window, so
    other months aren't listed into the scan.
    """
    started = F.col("ChargePeriodStart")
    monthly = MONTH in charges.columns
    if window.start is not None:
        charges = charges.filter(started >= window.start_date())
        if monthly:
            charges = charges.filter(F.col(MONTH) >= F.trunc(window.start_date(), "MM"))
    if window.end is not None:
        charges = charges.filter(started < window.end_date())
        if monthly:
            charges = charges.filter(F.col(MONTH) < window.end_date())
    return charges


def usage_scope(charges: DataFrame, usage_only: bool = True) -> DataFrame:
    """Charges that are not corrections and, unless told otherwise, are usage.

    A charge without a class is an ordinary charge and stays.
    """
    if usage_only:
        charges = charges.filter(F.col("ChargeCategory") == "Usage")
    charge_class = F.col("ChargeClass")
    return charges.filter(charge_class.isNull() | (charge_class != "Correction"))


_COMMITMENT_MARKS = {"id": "CommitmentDiscountId", "name": "CommitmentDiscountName"}


def under_commitment(charges: DataFrame, by: str = "id") -> DataFrame:
    """Charges under a commitment, told by its ``id`` or its ``name``; the two can disagree."""
    return charges.filter(F.col(_COMMITMENT_MARKS[by]).isNotNull())


def without_commitment(charges: DataFrame, by: str = "name") -> DataFrame:
    return charges.filter(F.col(_COMMITMENT_MARKS[by]).isNull())


def storage_scope(charges: DataFrame) -> DataFrame:
    """Storage meters other than bandwidth; a meter without a subcategory stays."""
    subcategory = F.col("x_SkuMeterSubcategory")
    return charges.filter(
        (F.col("x_SkuMeterCategory") == "Storage")
        & (subcategory.isNull() | (subcategory != "Bandwidth"))
    )
