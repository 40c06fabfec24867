"""Survey rows with the labels of both ends, under their display names, as Parquet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navette.functions.zorder import BITS, z_value
from navette.operators.lookup import Lookup
from navette.schemas import ENRICHED_COLUMNS, ENRICHED_SCHEMA
from navette.sources.published import publish_if_absent

#: Rows sampled for each file; with Spark's 100 the bounds of the files vary from run to run.
FILE_SAMPLE = 600


def group_places(registry: Lookup) -> Lookup:
    """Each group with its place in the order of names, spread over the numbers below 2^16.

    The window sees one row for each group, no more than the registry has rows. Groups beyond 2^16 share places.
    """
    groups = registry.frame.select("epci").where("epci is not null").distinct()
    place = F.floor(F.percent_rank().over(Window.orderBy("epci")) * ((1 << BITS) - 2)).cast("int") + 1
    return Lookup.of(groups.select("epci", place.alias("place")), "epci")


def dealt(labelled: DataFrame, registry: Lookup, files: int | None = None) -> DataFrame:
    """The rows in the order of the files, with their key.

    The key interleaves the bits of the places of the two groups, so a file covers few homes *and* few
    work places, and a request for either end skips most files by their statistics. A hash of the row after the key splits a
    pair of groups that holds many rows over several files. Labels follow from the codes, and the groups are in the
    key, so neither is hashed or compared again. The range partitioning reads ``labelled`` twice
    (a sample first), so callers pass stored rows.
    """
    rows = labelled.select(*ENRICHED_COLUMNS.values())
    places = group_places(registry)
    for end in ("resid", "work"):
        rows = places.attach(rows, f"{end}_epci", {"place": f"__{end}"})
    ends = [F.coalesce(F.col(f"__{end}"), F.lit(0)) for end in ("resid", "work")]
    spread = F.xxhash64("resid_code", "work_code", "weight", "mode_code")
    keyed = rows.withColumns({"__key": z_value(*ends), "__spread": spread}).drop("__resid", "__work")
    ranges = ["year", "__key", "__spread"]
    ranged = keyed.repartitionByRange(files, *ranges) if files else keyed.repartitionByRange(*ranges)
    return ranged.sortWithinPartitions("year", "__key")


def write_enriched(labelled: DataFrame, path: str, registry: Lookup, files: int | None = None) -> None:
    """Write by year, clustered on both groups at once; a larger sample than usual sets the bounds of the files."""
    shown = dealt(labelled, registry, files).select(*ENRICHED_COLUMNS.values())
    shown = shown.withColumnsRenamed({ours: name for name, ours in ENRICHED_COLUMNS.items()})
    conf, setting = labelled.sparkSession.conf, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = conf.get(setting)
    conf.set(setting, str(FILE_SAMPLE))
    try:
        shown.write.mode("overwrite").partitionBy("annee").parquet(path)
    finally:
        conf.set(setting, before)


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """The rows under the names used here; filters on year and groups prune the scan."""
    return spark.read.schema(ENRICHED_SCHEMA).parquet(path).withColumnsRenamed(ENRICHED_COLUMNS)


def _write(build: Callable[[], tuple[DataFrame, Lookup]], folder: str) -> None:
    labelled, registry = build()
    write_enriched(labelled, folder, registry)


def build_enriched_if_absent(
    spark: SparkSession,
    path: str,
    build: Callable[[], tuple[DataFrame, Lookup]],
    request: str = "",
    inputs: Sequence[str] = (),
) -> DataFrame:
    """Read the rows of ``request`` below ``path``; build (rows and registry) and write them first if they are not there."""
    table = publish_if_absent(
        spark, path, ENRICHED_SCHEMA, lambda folder: _write(build, folder), request, inputs
    )
    return table.withColumnsRenamed(ENRICHED_COLUMNS)
