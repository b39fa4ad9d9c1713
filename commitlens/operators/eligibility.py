"""Which charges a commitment could cover."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.catalogs import (
    COMPUTE_CATEGORIES,
    COMPUTE_FAMILIES,
    COMPUTE_PLAN_SKU_PREFIXES,
    ELIGIBLE_CATEGORIES,
    service_names,
)


def eligible_services(charges: DataFrame) -> DataFrame:
    """Charges of services that support reservations or savings plans, by name or category."""
    return _services(charges, service_names(), ELIGIBLE_CATEGORIES)


def compute_services(charges: DataFrame) -> DataFrame:
    """Charges of compute and app services, by name or category."""
    return _services(charges, service_names(*COMPUTE_FAMILIES), COMPUTE_CATEGORIES)


def _services(charges: DataFrame, names: Iterable[str], categories: Iterable[str]) -> DataFrame:
    by_name = F.col("ServiceName").isin(list(names))
    return charges.filter(by_name | F.col("ServiceCategory").isin(list(categories)))


def sku_prefix_eligible(
    charges: DataFrame, prefixes: Iterable[str] = COMPUTE_PLAN_SKU_PREFIXES
) -> DataFrame:
    """Charges whose SKU description starts with one of ``prefixes`` (case matters); none without any.

    One pattern does the work of all prefixes. Shared beginnings are written once in it, so a
    description is compared letter by letter against the list as a whole and not 192 times, and
    neither a join nor a shuffle is needed.
    """
    prefixes = list(prefixes)
    if not prefixes:
        return charges.filter(F.lit(False))
    return charges.filter(F.col("x_SkuDescription").rlike("^" + prefix_pattern(prefixes)))


def prefix_pattern(prefixes: Iterable[str]) -> str:
    """A regular expression for "one of ``prefixes``" with their common beginnings factored out."""
    by_first_letter: dict[str, list[str]] = {}
    for prefix in prefixes:
        if not prefix:
            return ""  # the empty prefix: everything below it starts alike
        by_first_letter.setdefault(prefix[0], []).append(prefix[1:])
    branches = [re.escape(letter) + prefix_pattern(rest) for letter, rest in by_first_letter.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
