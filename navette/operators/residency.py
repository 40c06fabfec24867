"""Counts of surveyed people by where they live and work relative to a group.

Flows come from ``touching`` or ``touching_group``: an end outside the group is unlabelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navette.functions.nulls import ratio
from navette.operators.flows import end_inside, name_ends
from navette.operators.lookup import Lookup


def observations(predicate: Column) -> Column:
    """Surveyed people for whom the predicate holds (NULL does not hold)."""
    return F.coalesce(F.sum(F.when(predicate, F.col("n_obs"))), F.lit(0).cast("bigint"))


def membership_stats(touched: DataFrame) -> DataFrame:
    """Per work commune: who lives in the group, works in it, both, only works."""
    lives, works = end_inside("resid"), end_inside("work")
    return (
        touched.groupBy("work_code")
        .agg(
            observations(lives).alias("n_resid"),
            observations(works).alias("n_work"),
            observations(lives & works).alias("n_both"),
            observations(~lives & works).alias("n_work_not_resid"),
        )
        .orderBy(F.col("n_resid").desc(), "work_code")
    )


def top_work_communes(stats: DataFrame, registry: Lookup, n: int) -> DataFrame:
    """The ``n`` rows of ``membership_stats`` with most residents, names put back."""
    top = stats.orderBy(F.col("n_resid").desc(), "work_code").limit(n)
    return name_ends(top, registry, "work")


def headline_counts(touched: DataFrame, *by: str) -> DataFrame:
    """Touching, resident, working, both and incoming people, in one pass."""
    lives, works = end_inside("resid"), end_inside("work")
    return (
        touched.groupBy(*by)
        .agg(
            observations(F.lit(True)).alias("n_touching"),
            observations(lives).alias("n_residents"),
            observations(works).alias("n_workers"),
            observations(lives & works).alias("n_both"),
            observations(~lives & works).alias("n_incoming"),
        )
    )


def work_commune_residency(touched: DataFrame, members: Lookup, *by: str) -> DataFrame:
    """Per work commune of the group: where its workers live.

    ``n_own_commune`` counts people who live in the commune they work in;
    membership of the whole group is counted separately.
    """
    lives = end_inside("resid")
    working = touched.filter(end_inside("work"))
    counted = working.groupBy(*by, "work_code").agg(
        observations(F.lit(True)).alias("n_total"),
        observations(lives).alias("n_resident_in_epci"),
        observations(~lives).alias("n_nonresident"),
        observations(F.col("resid_code") == F.col("work_code")).alias("n_own_commune"),
    )
    return (
        name_ends(counted, members, "work")
        .withColumn(
            "share_nonresident",
            ratio(F.col("n_nonresident").cast("double"), F.col("n_total").cast("double")),
        )
        .orderBy(*by, F.col("share_nonresident").desc(), "work_name")
    )
