"""Display order of communes and top-k questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navette.operators.flows import name_ends, totals
from navette.operators.lookup import Lookup


def commune_order(labelled: DataFrame, *by: str) -> DataFrame:
    """Communes of residence by descending flow within ``by``, names breaking ties.

    The ranking sees one row per registered commune, never the flows themselves.
    """
    per_commune = totals(labelled, *by, "resid_code", "resid_name")
    order = Window.partitionBy(*by).orderBy(
        F.col("flow").desc(), F.col("resid_name"), F.col("resid_code")
    )
    return (
        per_commune.filter(F.col("resid_name").isNotNull())
        .withColumn("position", F.row_number().over(order))
        .select(*by, "resid_code", "resid_name", "flow", "position")
    )


def _place_key(code: str, *by: str) -> Column:
    """Text key of a commune in its table; NULL if any part is."""
    parts = [F.col(c).cast("string") for c in (*by, code)]
    return F.concat(*[part for p in parts for part in (p, F.lit("\x1f"))][:-1])


def order_lookup(order: DataFrame, *by: str) -> DataFrame:
    """``commune_order`` as rows of one text key (``code``) and the position, to be measured as a ``Lookup``."""
    return order.select(_place_key("resid_code", *by).alias("code"), "position")


def with_display_order(od: DataFrame, order: Lookup, *by: str) -> DataFrame:
    """Positions of both ends in ``order``, an ``order_lookup`` that was measured once.

    An end that is not in the order (nobody lives there) gets NULL. Rows are not sorted; see ``in_display_order``.
    """
    for end in ("resid", "work"):
        keyed = od.withColumn("__place", _place_key(f"{end}_code", *by))
        od = order.attach(keyed, "__place", {"position": f"{end}_position"}).drop("__place")
    return od


def in_display_order(od: DataFrame, *by: str) -> DataFrame:
    """The rows sorted for display, unranked ends last: for one report, not for whole tables."""
    positions = [F.col(f"{end}_position").asc_nulls_last() for end in ("resid", "work")]
    return od.orderBy(*by, *positions, "mode")


def top_origins(flows: DataFrame, registry: Lookup, work_code: str, n: int) -> DataFrame:
    """The ``n`` communes that send the largest flow into one commune."""
    entering = flows.filter(
        (F.col("work_code") == work_code) & (F.col("resid_code") != work_code)
    )
    named = name_ends(totals(entering, "resid_code"), registry, "resid")
    return (
        named.select("resid_code", "resid_name", "flow")
        .orderBy(F.col("flow").desc(), F.col("resid_name").asc_nulls_last(), "resid_code")
        .limit(n)
    )
