"""Corrections of a stored mart as signed flows that are added to it.

The mart is additive, so a correction of some survey rows is the mart of the rows that come in minus the mart of
the rows that go out. Its size follows the corrected rows, not the year. Readers add it on the fly
(``corrected``), until a new copy of the year is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navette.functions.nulls import wsum
from navette.operators.flows import MART_KEYS, as_flows, label_ends
from navette.operators.lookup import Lookup
from navette.schemas import MART_SCHEMA

#: What tells the cells of a mart apart; labels follow from the codes, and with them filters on groups reach each scan.
CELL = [name for name in MART_SCHEMA.names if name not in ("flow", "n_obs")]


def correction(withdrawn: DataFrame | None, added: DataFrame | None, registry: Lookup, exact: bool = False) -> DataFrame:
    """Signed flows and counts per cell of the mart, from survey rows (with ``mode``) that go out and come in.

    A row whose weight changes is given on both sides. Cells in which nothing changes are left out. The registry must
    be the one the mart was labelled with.
    """
    sides = []
    for rows, sign in ((withdrawn, -1), (added, 1)):
        if rows is not None:
            one = as_flows(rows).withColumns({"flow": F.col("flow") * sign, "n_obs": F.col("n_obs") * sign})
            sides.append(one.select(*MART_KEYS, "flow", "n_obs"))
    if not sides:
        raise ValueError("a correction needs rows that go out or come in")
    summed = reduce(DataFrame.unionByName, sides).groupBy(*MART_KEYS)
    changes = summed.agg(wsum("flow", exact).alias("flow"), F.sum("n_obs").alias("n_obs"))
    return label_ends(changes.where("flow <> 0 OR n_obs <> 0"), registry).select(*MART_SCHEMA.names)


def corrected(mart: DataFrame, *corrections: DataFrame, exact: bool = False) -> DataFrame:
    """The mart with corrections added; equal to the mart of the corrected survey rows.

    Cells without rows left go. A cell that would hold fewer rows than none stops the query: the correction withdraws rows the
    mart does not hold, or was labelled with another registry. Filters on years, groups and codes reach
    the scans of the mart and of each correction. ``exact`` adds weights as decimals.
    """
    parts = [part.select(*MART_SCHEMA.names) for part in (mart, *corrections)]
    summed = reduce(DataFrame.unionByName, parts).groupBy(*CELL)
    cells = summed.agg(F.sum("n_obs").alias("n_obs"), wsum("flow", exact).alias("flow")).where("n_obs <> 0")
    beyond = F.raise_error(F.concat(F.lit("more rows withdrawn than the mart holds: "), F.to_json(F.struct(*MART_KEYS))))
    n_obs = F.when(F.col("n_obs") < 0, beyond.cast("bigint")).otherwise(F.col("n_obs"))
    return cells.withColumn("n_obs", n_obs).select(*MART_SCHEMA.names)
