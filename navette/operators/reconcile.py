"""Comparison of computed pair totals with published ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["resid_code", "work_code"]


def reconcile(computed: DataFrame, published: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Every pair of either side with both totals, their difference and a status.

    A missing end is an end of its own, so it finds its counterpart.
    """
    ours = computed.select(*PAIR, F.col("flow").alias("computed"))
    theirs = published.select(*PAIR, "published")
    difference = F.col("computed") - F.col("published")
    status = (
        F.when(F.col("published").isNull(), "not published")
        .when(F.col("computed").isNull(), "not computed")
        .when(F.abs(difference) > tolerance, "different")
        .otherwise("equal")
    )
    theirs = theirs.withColumnsRenamed({end: f"__{end}" for end in PAIR})
    same = [F.col(end).eqNullSafe(F.col(f"__{end}")) for end in PAIR]
    ends = [F.coalesce(end, f"__{end}").alias(end) for end in PAIR]
    return ours.join(theirs, same, "full_outer").select(
        *ends, "computed", "published", difference.alias("difference"), status.alias("status")
    )
