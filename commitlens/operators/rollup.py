"""Grouped totals that are built in two steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.functions.measures import (
    double,
    is_committed,
    is_unnamed,
    mean,
    sum_where,
    usage_day,
)

# Rollup column suffix -> charge measure.
DAILY_MEASURES = {"effective": "EffectiveCost", "list": "ListCost", "contracted": "ContractedCost"}


def daily_rollup(charges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per day with charges (and ``keys``): total and uncovered sums of each cost.

    A day without a charge has no row. Both sums of a cost are made in one step, hence one shuffle.
    """
    return charges.groupBy(*keys, usage_day().alias("usage_day")).agg(
        *[F.sum(m).alias(f"daily_total_{name}") for name, m in DAILY_MEASURES.items()],
        *[sum_where(is_unnamed(), m).alias(f"daily_uncovered_{name}") for name, m in DAILY_MEASURES.items()],
    )


def coverage_rollup(charges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Costs split by pricing category, with the number of resources on either side.

    ``Covered*`` and ``Uncovered*`` are sums by pricing category, ``CoveredResources``,
    ``UncoveredResources`` and ``Resources`` exact distinct counts of ``ResourceId``.

    Counting one id under several conditions with ``countDistinct`` would copy every charge once
    per condition. Charges are grouped by id first, with a flag for each side that the id is on;
    counting the flags is exact, needs no copy and one shuffle less than another distinct count, and
    a group that holds a large part of the table is spread over its resources. Charges without a
    resource form rows of their own in that step: their costs count, a resource does not.
    """
    costs = ("EffectiveCost", "ListCost")
    committed, resource = is_committed(), F.col("ResourceId")
    per_resource = charges.groupBy(*keys, "ResourceId").agg(
        *[F.sum(c).alias(c) for c in costs],
        *[sum_where(committed, c).alias(f"Covered{c}") for c in costs],
        F.max(committed).alias("covered"),
        F.max(~committed).alias("uncovered"),
    )
    groups = per_resource.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in costs],
        *[F.sum(f"Covered{c}").alias(f"Covered{c}") for c in costs],
        F.max("covered").alias("any_covered"),
        F.count(F.when(F.col("covered"), resource)).alias("CoveredResources"),
        F.count(F.when(F.col("uncovered"), resource)).alias("UncoveredResources"),
        F.count(resource).alias("Resources"),
    )
    return groups.select(
        *keys,
        *[c for cost in costs for c in (cost, f"Covered{cost}")],
        *[_rest(c).alias(f"Uncovered{c}") for c in costs],
        "CoveredResources",
        "UncoveredResources",
        "Resources",
    )


def _rest(cost: str) -> Column:
    """What is not covered: NULL where no charge has a cost and none is covered, as a sum of such charges is."""
    zero = F.lit(0)
    rest = F.coalesce(cost, zero) - F.coalesce(f"Covered{cost}", zero)
    return F.when(F.col(cost).isNotNull() | F.col("any_covered"), rest)


def spend_distribution(
    daily: DataFrame, values: Sequence[str], percents: Sequence[int], keys: Sequence[str] = ()
) -> DataFrame:
    """How the daily ``values`` are spread over the days of each group, and the sums of the rollup.

    Per value ``v``: ``v_min``, ``v_p<percent>``, ``v_max`` and ``v_mean``. ``days`` is the number
    of rows. The sums keep the names of the rollup's columns. Percentiles are observed values.
    """
    sums = [f"daily_{side}_{name}" for side in ("total", "uncovered") for name in DAILY_MEASURES]
    fractions = [p / 100 for p in percents]
    # The sums take their columns' names, so the values are set aside under other ones.
    observed = daily.select(*keys, *sums, *[double(v).alias(f"{v}_day") for v in values])
    grouped = observed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        *[F.sum(s).alias(s) for s in sums],
        *[F.count(f"{v}_day").alias(f"{v}_count") for v in values],
        *[F.min(f"{v}_day").alias(f"{v}_min") for v in values],
        *[F.max(f"{v}_day").alias(f"{v}_max") for v in values],
        *[F.percentile_approx(f"{v}_day", fractions, 10000).alias(f"{v}_pct") for v in values],
    )
    described: list[Column] = []
    for v in values:
        described += [F.col(f"{v}_min")]
        described += [F.col(f"{v}_pct")[i].alias(f"{v}_p{p}") for i, p in enumerate(percents)]
        described += [F.col(f"{v}_max"), mean(v, f"{v}_count").alias(f"{v}_mean")]
    return grouped.select(*keys, "days", *sums, *described)


def share_of_total(grouped: DataFrame, value: str, partition: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: ``value`` as a percentage of its sum over ``partition``.

    ``grouped`` holds group totals, a few rows per partition. NULL where the sum is 0.
    """
    whole = F.sum(value).over(Window.partitionBy(*partition))
    return grouped.withColumn(name, double(value) * 100.0 / F.nullif(double(whole), F.lit(0.0)))
