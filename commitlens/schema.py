"""The billing charge table: one row per charge of a resource in a charge period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COST = T.DecimalType(18, 6)
QUANTITY = T.DecimalType(18, 6)
# For measures stored as floating point or text. Sums keep its scale; one beyond 20 digits is an error.
WIDE = T.DecimalType(38, 18)

_TEXT = [
    "ProviderName",
    "ServiceCategory",
    "ServiceName",
    "RegionId",
    "RegionName",
]
_COSTS = ["ListCost", "EffectiveCost", "ContractedCost"]
_NULL_TEXT = [
    "CommitmentDiscountId",
    "CommitmentDiscountName",
    "CommitmentDiscountType",
    "ResourceId",
    "ChargeCategory",
    "ChargeClass",
]
_PERIOD = ["ChargePeriodStart", "ChargePeriodEnd"]
_SKU_TEXT = [
    "PricingCategory",
    "ChargeDescription",
    "SkuId",
    "SkuPriceId",
    "x_SkuDescription",
    "x_SkuMeterCategory",
    "x_SkuMeterSubcategory",
]

# Costs are decimals so that a sum does not depend on the order in which partitions are merged.
CHARGE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, COST) for c in _COSTS]
    + [T.StructField("PricingQuantity", QUANTITY)]
    + [T.StructField(c, T.StringType()) for c in _NULL_TEXT]
    + [T.StructField(c, T.TimestampNTZType()) for c in _PERIOD]
    + [T.StructField(c, T.StringType()) for c in _SKU_TEXT]
)

CHARGE_COLUMNS = CHARGE_SCHEMA.fieldNames()

_MEASURES = [*_COSTS, "PricingQuantity"]
_TIME_TYPES = (T.TimestampNTZType, T.TimestampType, T.DateType, T.StringType)
_UTC = {"UTC", "ETC/UTC", "GMT", "Z", "+00:00"}

# The month partition of a stored table, as ``read_charges`` names it.
MONTH = "charge_month"

# What text formats hold: measures exact, times as text.
TEXT_SCHEMA = T.StructType(
    [T.StructField(f.name, WIDE if f.name in _MEASURES else T.StringType()) for f in CHARGE_SCHEMA]
)


class ChargeSchemaError(ValueError):
    """The input is not a usable charge table."""


def conform(
    df: DataFrame, columns: Sequence[str] | None = None, month_column: str | None = None
) -> DataFrame:
    """Project ``df`` onto the charge columns, with measures as exact decimals.

    ``columns`` narrows the check to the columns a caller needs. Stored decimals stay as they are;
    floating point, integers and text are widened, so that no charge is rounded before it is summed. Times keep
    their stored type, as a cast would keep the window filter from the file scan; only text is
    turned into times, in UTC. A time with a zone is taken in the session's, which must be UTC.
    ``month_column`` is kept as ``MONTH``.
    """
    wanted = list(columns or CHARGE_COLUMNS)
    unknown = [c for c in wanted if c not in CHARGE_COLUMNS]
    missing = [c for c in wanted if c not in df.columns]
    if unknown or missing:
        raise ChargeSchemaError(f"missing columns: {missing}; not charge columns: {unknown}")
    projected = []
    for name in wanted:
        have, want = df.schema[name].dataType, CHARGE_SCHEMA[name].dataType
        if name in _PERIOD:
            if not isinstance(have, _TIME_TYPES):
                raise ChargeSchemaError(f"{name} must be a date or timestamp, not {have.simpleString()}")
            if isinstance(have, T.TimestampType):
                zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
                if zone.upper() not in _UTC:
                    raise ChargeSchemaError(f"{name} has a zone; set spark.sql.session.timeZone to UTC, not {zone}")
            text = isinstance(have, T.StringType)
            projected.append(F.col(name).cast("timestamp_ntz").alias(name) if text else F.col(name))
        elif name in _MEASURES:
            stored = isinstance(have, T.DecimalType)
            projected.append(F.col(name) if stored else F.col(name).cast(WIDE).alias(name))
        elif have == want:
            projected.append(F.col(name))
        else:
            projected.append(F.col(name).cast(want).alias(name))
    if month_column is not None:
        projected.append(F.col(month_column).cast("date").alias(MONTH))
    return df.select(*projected)
