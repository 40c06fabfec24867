"""Registry editions: codes and labels as they were in the year of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navette.operators.flows import MART_KEYS, totals
from navette.operators.lookup import Lookup

#: Changes that one code may go through.
MAX_STEPS = 16


def _dated(code: str) -> Column:
    """Text key of a code in a year; NULL if either is."""
    return F.concat(F.col("year").cast("string"), F.lit("\x1f"), F.col(code))


def _each_year(table: DataFrame, first: Column, last: Column, years: DataFrame) -> DataFrame:
    """The rows once for each survey year from ``first`` to ``last`` (NULL: no end)."""
    ends = years.agg(F.min("year").alias("low"), F.max("year").alias("high")).first()
    if ends["low"] is None:
        return table.withColumn("year", F.lit(None).cast("int")).limit(0)
    low, high = F.greatest(first, F.lit(ends["low"])), F.least(F.coalesce(last, F.lit(ends["high"])), F.lit(ends["high"]))
    return table.where(low <= high).withColumn("year", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def editions_by_year(editions: DataFrame, years: DataFrame) -> Lookup:
    """``code, name, epci, valid_from, valid_to`` as a lookup of each code in each survey year.

    An edition holds from its first year up to, not including, ``valid_to`` (NULL: still valid). Editions of a code that
    overlap in a survey year give two rows of one key, which the lookup refuses.
    """
    dated = _each_year(editions, F.col("valid_from"), F.col("valid_to") - 1, years)
    return Lookup.of(dated.select(_dated("code").alias("code"), "name", "epci"), "code")


def changes_by_year(changes: DataFrame, years: DataFrame) -> Lookup:
    """``old_code, new_code, since`` as a lookup of what stands for a code in each survey year, chains followed.

    ``changes`` has a row for each merged commune, so it is joined with itself. A code that comes back to itself is an error.
    """
    steps = changes.select("old_code", "new_code", "since", F.lit(1).alias("step"))
    reach, ahead = steps, steps
    later = changes.select(F.col("old_code").alias("from"), F.col("new_code").alias("to"), F.col("since").alias("then"))
    while not ahead.isEmpty():
        if ahead.first()["step"] > MAX_STEPS or not ahead.where("old_code = new_code").isEmpty():
            raise ValueError("the table of code changes leads a code back to itself")
        ahead = ahead.join(later, F.col("new_code") == F.col("from")).select(
            "old_code", F.col("to").alias("new_code"), F.greatest("since", "then").alias("since"), (F.col("step") + 1).alias("step")
        )
        reach = reach.union(ahead)
    dated = _each_year(reach, F.col("since"), F.lit(None).cast("int"), years)
    last = dated.groupBy(_dated("old_code").alias("old_code")).agg(
        F.max_by("new_code", F.struct("since", "step")).alias("new_code")
    )
    return Lookup.of(last, "old_code")


def codes_as_of(flows: DataFrame, changes: Lookup) -> DataFrame:
    """Both ends under the codes that hold in the row's year."""
    for end in ("resid", "work"):
        dated = flows.withColumn("__dated", _dated(f"{end}_code"))
        found = changes.attach(dated, "__dated", {"new_code": "__new"})
        flows = found.withColumn(f"{end}_code", F.coalesce("__new", f"{end}_code")).drop("__dated", "__new")
    return flows


def label_ends_as_of(flows: DataFrame, editions: Lookup) -> DataFrame:
    """Name and group of both ends by the edition of the row's year; NULL outside it."""
    for end in ("resid", "work"):
        dated = flows.withColumn("__dated", _dated(f"{end}_code"))
        flows = editions.attach(dated, "__dated", {"name": f"{end}_name", "epci": f"{end}_epci"}).drop("__dated")
    return flows


def flow_mart_as_of(flows: DataFrame, editions: Lookup, changes: Lookup) -> DataFrame:
    """``flow_mart`` whose codes and labels are those of each survey year, from survey rows as flows or from the mart.

    Rows are summed by the codes of the files first, so codes change on the small result, which is summed again.
    """
    first = totals(flows, *MART_KEYS)
    return label_ends_as_of(totals(codes_as_of(first, changes), *MART_KEYS), editions)
