"""Null rules the census tables rely on, made explicit for Spark.

Spark's ``isin`` and ``sum`` return NULL where the analysis expects FALSE and 0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wide enough for a national total with six decimals of weight.
EXACT_WEIGHT = "decimal(18,6)"


def in_set(col: Column, values: Iterable[str]) -> Column:
    """Membership that is FALSE for NULL, so its negation keeps the row."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def wsum(weight: Column | str, exact: bool = False) -> Column:
    """Weighted total: NULL weights count as 0, also when all are NULL.

    ``exact`` adds the weights as decimals, so the total does not depend on the
    order in which partial sums arrive.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    if exact:
        return F.coalesce(F.sum(weight.cast(EXACT_WEIGHT)).cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(weight), F.lit(0.0))


def ratio(part: Column, total: Column) -> Column:
    """Division that gives NULL for a zero total instead of an error."""
    return part / F.nullif(total, F.lit(0.0))


def row_sum(*cols: Column | str) -> Column:
    """Row-wise sum in which a missing value counts as 0."""
    total = F.lit(0.0)
    for col in cols:
        col = F.col(col) if isinstance(col, str) else col
        total = total + F.coalesce(col, F.lit(0.0))
    return total
