"""The flow mart on disk: Parquet by year, clustered on the two groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from navette.schemas import MART_SCHEMA
from navette.sources.published import publish_if_absent


def write_mart(mart: DataFrame, path: str) -> None:
    """Write the mart so that readers can skip files and row groups.

    Range partitioning on year, groups and codes splits a large year or group
    over many tasks (the mart has one row per pair and mode, so no range is hot),
    and the sort inside each file makes row-group statistics selective.
    """
    (
        mart.select(*MART_SCHEMA.names)
        .repartitionByRange("year", "resid_epci", "work_epci", "resid_code", "work_code")
        .sortWithinPartitions("year", "resid_epci", "work_epci")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    """The mart with its declared schema; filters on year and groups prune it."""
    return spark.read.schema(MART_SCHEMA).parquet(path)


def build_mart_if_absent(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    request: str = "",
    check: Callable[[], object] | None = None,
    inputs: Sequence[str] = (),
) -> DataFrame:
    """Read the mart of ``request`` below ``path``; build and write it first if it is not there or its ``inputs`` changed.

    ``check`` runs after the write; what it raises leaves the mart unpublished.
    """

    def write(folder: str) -> None:
        write_mart(build(), folder)
        if check is not None:
            check()

    return publish_if_absent(spark, path, MART_SCHEMA, write, request, inputs)
