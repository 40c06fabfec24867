"""Origin-destination tables: wide form, desire lines, undirected flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navette.functions.modes import MODE_COLUMNS, mode_comparable
from navette.functions.nulls import in_set, ratio, row_sum, wsum
from navette.operators.flows import undirected
from navette.operators.lookup import Lookup
from navette.sources.geojson import COORDINATE

OTHER = "other"
MEASURES = [*MODE_COLUMNS.values(), OTHER]


def od_wide(flows: DataFrame, *by: str) -> DataFrame:
    """One row per ``by`` with one column per mode and the total.

    All columns come from one aggregate, so there is one shuffle. A mode without
    rows is NULL; unlisted and missing modes share the column ``other``, which
    keeps the schema fixed and the total equal to the sum of the columns.
    """
    tests = {column: F.col("mode") == mode for mode, column in MODE_COLUMNS.items()}
    tests[OTHER] = ~in_set(F.col("mode"), MODE_COLUMNS)
    columns = []
    for column, test in tests.items():
        present = F.count_if(test) > 0
        columns.append(F.when(present, wsum(F.when(test, F.col("flow")))).alias(column))
    return flows.groupBy(*by).agg(*columns, wsum("flow").alias("total"))


def with_row_total(wide: DataFrame) -> DataFrame:
    """The total once more, from the mode columns; a missing mode counts as 0."""
    return wide.withColumn("total_of_modes", row_sum(*MEASURES))


def between_communes(od: DataFrame) -> DataFrame:
    """Pairs of two different known communes."""
    resid, work = F.col("resid_code"), F.col("work_code")
    return od.filter(resid.isNotNull() & work.isNotNull()).filter(resid != work)


def _wkt_point(lon: str, lat: str) -> Column:
    return F.concat_ws(" ", F.col(lon).cast(COORDINATE), F.col(lat).cast(COORDINATE))


def desire_lines(od: DataFrame, centroids: Lookup, start: str, end: str) -> DataFrame:
    """Straight line between the centroids of two code columns, as WKT.

    Pairs without both centroids have no line and are left out.
    """
    od = centroids.attach(od, start, {"lon": "__lon_a", "lat": "__lat_a"}, "inner")
    od = centroids.attach(od, end, {"lon": "__lon_b", "lat": "__lat_b"}, "inner")
    line = F.concat(
        F.lit("LINESTRING ("),
        _wkt_point("__lon_a", "__lat_a"),
        F.lit(", "),
        _wkt_point("__lon_b", "__lat_b"),
        F.lit(")"),
    )
    return od.withColumn("line", line).drop("__lon_a", "__lat_a", "__lon_b", "__lat_b")


def od_oneway(wide: DataFrame, *by: str) -> DataFrame:
    """A to B and B to A merged into one pair, measures added, missing as 0."""
    pairs = undirected(between_communes(wide))
    return pairs.groupBy(*by, "code_a", "code_b").agg(
        *[wsum(m).alias(m) for m in MEASURES], wsum("total").alias("total")
    )


def od_oneway_from_flows(flows: DataFrame, *by: str) -> DataFrame:
    """The same without the directed wide table, so with one shuffle instead of two.

    A mode no traveller of the pair used is 0.
    """
    wide = od_wide(undirected(between_communes(flows)), *by, "code_a", "code_b")
    return wide.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in MEASURES})


def with_shares(oneway: DataFrame, comparable: Column | None = None) -> DataFrame:
    """Active (cycling, walking) and sustainable (with public transport) shares.

    They are NULL where ``comparable`` does not hold. Left out, it is judged by the
    survey year, where the frame has one; frames recoded by one list for all years pass TRUE.
    """
    if comparable is None:
        comparable = mode_comparable(F.col("year")) if "year" in oneway.columns else F.lit(True)
    active = ratio(row_sum("velo", "marche"), F.col("total"))
    sustainable = ratio(row_sum("velo", "marche", "tc"), F.col("total"))
    return oneway.withColumns(
        {
            "share_active": F.when(comparable, active),
            "share_sustainable": F.when(comparable, sustainable),
        }
    )
