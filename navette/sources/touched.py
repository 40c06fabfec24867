"""The flow mart under the group it touches: a bucketed copy for requests about either end.

Each flow stands under the group of its home and under that of its work place, once if they are the same. The table is
bucketed by that group, so that sums and shares by group (in, out and inside) need no shuffle and no
explode when they are read. All rows of a group lie in one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from navette.operators.flows import by_touched_group
from navette.schemas import MART_SCHEMA

BUCKETS = 32


def write_touched(mart: DataFrame, path: str, name: str, buckets: int = BUCKETS) -> None:
    """Write the copy to ``path`` and register it as table ``name``; one file for each bucket."""
    touched = by_touched_group(mart.select(*MART_SCHEMA.names))
    (
        touched.repartition(buckets, "epci")
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, "epci")
        .sortBy("epci", "year")
        .saveAsTable(name)
    )


def read_touched(spark: SparkSession, path: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """The copy at ``path``; an application that has not registered it yet does so under ``name``."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MART_SCHEMA.fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}, epci STRING) USING parquet "
            f"CLUSTERED BY (epci) SORTED BY (epci, year) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)
