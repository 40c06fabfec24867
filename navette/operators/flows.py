"""From survey rows to labelled flows, selections of flows, and the flow mart.

A *flow* frame has ``year, resid_code, work_code, mode, flow, n_obs``. Survey rows
and the mart both fit, so every operator gives the same result on either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navette.functions.modes import mode_comparable, recode_mode
from navette.functions.nulls import wsum
from navette.operators.lookup import Lookup

MART_KEYS = ["year", "resid_code", "work_code", "mode"]


def with_mode(flux: DataFrame) -> DataFrame:
    """Add the mode label and whether it can be compared across years."""
    year = F.col("year")
    return flux.withColumns(
        {
            "mode": recode_mode(F.col("mode_code"), year),
            "mode_comparable": mode_comparable(year),
        }
    )


def as_flows(flux: DataFrame) -> DataFrame:
    """Survey rows as flows: each row counts once and weighs its weight."""
    return flux.withColumns({"flow": F.col("weight"), "n_obs": F.lit(1).cast("bigint")})


def totals(flows: DataFrame, *keys: str, exact: bool = False) -> DataFrame:
    """Weighted total and number of observations per key; NULL is a key of its own.

    ``exact`` sums the weights as decimals, for totals that must not depend on the
    order of rows.
    """
    return flows.groupBy(*keys).agg(
        wsum("flow", exact).alias("flow"), F.coalesce(F.sum("n_obs"), F.lit(0)).alias("n_obs")
    )


def label_ends(flows: DataFrame, registry: Lookup) -> DataFrame:
    """Name and group of both ends; an end outside the registry gets NULL."""
    for end in ("resid", "work"):
        flows = registry.attach(
            flows, f"{end}_code", {"name": f"{end}_name", "epci": f"{end}_epci"}
        )
    return flows


def name_ends(flows: DataFrame, registry: Lookup, *ends: str) -> DataFrame:
    """Only the names, for the given ends (``resid``, ``work``)."""
    for end in ends:
        flows = registry.attach(flows, f"{end}_code", {"name": f"{end}_name"})
    return flows


def flow_mart(flux: DataFrame, registry: Lookup, exact: bool = False) -> DataFrame:
    """Additive pre-aggregate that the other operators can read.

    Rows are summed by code before any label is attached: the sum is combined on
    the map side, so a frequent pair costs one row per task in the shuffle, and
    the labels are joined to the small result.
    """
    return label_ends(totals(as_flows(flux), *MART_KEYS, exact=exact), registry)


def undirected(flows: DataFrame) -> DataFrame:
    """Add both ends in text order, so that A to B and B to A share a pair."""
    return flows.withColumns(
        {
            "code_a": F.least("resid_code", "work_code"),
            "code_b": F.greatest("resid_code", "work_code"),
        }
    )


def residents_of(flows: DataFrame, members: Lookup) -> DataFrame:
    return members.keep_members(flows, "resid_code")


def workers_in(flows: DataFrame, members: Lookup) -> DataFrame:
    return members.keep_members(flows, "work_code")


def end_inside(end: str) -> Column:
    """TRUE or FALSE, never NULL, once ``label_ends`` has run."""
    return F.col(f"{end}_epci").isNotNull()


def touching(flows: DataFrame, members: Lookup) -> DataFrame:
    """Flows with at least one end among the members, outsiders left unlabelled."""
    return label_ends(flows, members).filter(end_inside("resid") | end_inside("work"))


def touching_group(labelled: DataFrame, epci: str) -> DataFrame:
    """``touching`` for flows that already carry the groups of both ends.

    The test is on plain columns, so on the mart it reaches the Parquet scan.
    Labels of the ends outside the group are blanked.
    """
    kept = labelled.filter((F.col("resid_epci") == epci) | (F.col("work_epci") == epci))
    return _labels_of(kept, epci)


def workers_of_group(labelled: DataFrame, epci: str) -> DataFrame:
    """Flows that end in the group, labels of homes outside it blanked."""
    return _labels_of(labelled.filter(F.col("work_epci") == epci), epci)


def _labels_of(labelled: DataFrame, epci: str) -> DataFrame:
    blanked = {}
    for end in ("resid", "work"):
        inside = F.col(f"{end}_epci") == epci
        for label in ("name", "epci"):
            blanked[f"{end}_{label}"] = F.when(inside, F.col(f"{end}_{label}"))
    return labelled.withColumns(blanked)


def within(labelled: DataFrame, year: int | None = None, epci: str | None = None) -> DataFrame:
    """Flows that stay inside one group, optionally one year and one group."""
    kept = labelled
    if year is not None:
        kept = kept.filter(F.col("year") == year)
    if epci is not None:
        return kept.filter((F.col("resid_epci") == epci) & (F.col("work_epci") == epci))
    return kept.filter(F.col("resid_epci") == F.col("work_epci")).withColumn(
        "epci", F.col("resid_epci")
    )


def outsiders_to_null(selected: DataFrame) -> DataFrame:
    """Blank the code of unlabelled ends, so that all outsiders form one group."""
    return selected.withColumns(
        {f"{end}_code": F.when(end_inside(end), F.col(f"{end}_code")) for end in ("resid", "work")}
    )


def by_touched_group(labelled: DataFrame) -> DataFrame:
    """Each flow under the group of its residence and under that of its workplace.

    A flow inside one group appears once. Labels are kept as they are.
    """
    groups = F.array_distinct(F.array_compact(F.array("resid_epci", "work_epci")))
    return labelled.withColumn("epci", F.explode(groups))


def outsiders_of_group_to_null(touched: DataFrame) -> DataFrame:
    """As ``outsiders_to_null``, with respect to the ``epci`` of the row."""
    blanked = {}
    for end in ("resid", "work"):
        inside = F.col(f"{end}_epci").eqNullSafe(F.col("epci"))
        for label in ("code", "name"):
            blanked[f"{end}_{label}"] = F.when(inside, F.col(f"{end}_{label}"))
    return touched.withColumns(blanked)
