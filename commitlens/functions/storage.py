"""Classification of storage charges."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Premium disks of 1 TiB and more. The size is a word of its own, with a blank after.
RESERVABLE_DISKS = "- P(30|40|50|60|80) "


def storage_capacity_class() -> Column:
    """'Yes' for a charge for stored capacity, which a reservation can cover, else 'No'.

    Operations, snapshots and the like are not capacity. A charge without a description is 'No':
    no test below holds for a NULL text.
    """
    kind = F.col("x_SkuMeterSubcategory")
    text = F.col("ChargeDescription")
    stored = text.contains("Data Stored")
    tests = [
        (kind == "Premium SSD Managed Disks") & text.rlike(RESERVABLE_DISKS),
        (kind == "Ultra Disks") & text.contains("Provisioned Capacity"),
        (kind == "Tiered Block Blob") & stored,
        kind.isin("Files", "Files v2") & stored,
        kind.contains("NetApp") & ~text.contains("Operations") & ~text.contains("Snapshots"),
        kind.contains("Backup") & stored,
    ]
    return F.when(reduce(operator.or_, tests), "Yes").otherwise("No")
