"""Modal shares within any group of flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navette.functions.labels import od_share_label, share_label
from navette.functions.nulls import ratio
from navette.operators.flows import totals


def mode_shares(flows: DataFrame, *by: str) -> DataFrame:
    """Flow per mode with the total of its group and its share of that total."""
    return share_of_total(totals(flows, *by, "mode").drop("n_obs"), *by)


def share_of_total(per_mode: DataFrame, *by: str) -> DataFrame:
    """Total and share for rows that are already one per ``by`` and mode.

    The total is a window over aggregated rows: a group holds one row per mode
    however many travellers it has, and NULL keys find their total.
    """
    return per_mode.withColumn(
        "total", F.sum("flow").over(Window.partitionBy(*by))
    ).withColumn("share", ratio(F.col("flow"), F.col("total")))


def with_share_label(shares: DataFrame) -> DataFrame:
    return shares.withColumn(
        "label", share_label(F.col("flow"), F.col("total"), F.col("share"))
    )


def with_od_share_label(shares: DataFrame) -> DataFrame:
    return shares.withColumn(
        "label", od_share_label(F.col("mode"), F.col("flow"), F.col("total"), F.col("share"))
    )
