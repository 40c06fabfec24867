"""The municipality registry: code, name and group of every commune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navette.operators.lookup import Lookup
from navette.schemas import REGISTRY_COLUMNS

HEADER_CELL = "CODGEO"


def read_registry_sheet(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Registry sheet saved as delimited text, with any preamble above its header.

    The header is the first line with a ``CODGEO`` cell; only lines below it are
    data. Line order comes from the file, the block a line was read from and its
    position there, so the sheet may be split between tasks, or into several files
    whose names follow its order.
    """
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("at"),
    )
    header = (
        lines.filter(F.array_contains(F.split(F.translate("value", '"', ""), rf"\Q{sep}\E"), HEADER_CELL))
        .agg(F.min("at").alias("at"), F.min_by("value", "at").alias("value"))
        .first()
    )
    if header["value"] is None:
        raise ValueError(f"no line with a {HEADER_CELL} cell in {path}")
    names = [name.strip() for name in header["value"].replace('"', "").split(sep)]
    schema = ", ".join(f"`{name or f'_c{i}'}` STRING" for i, name in enumerate(names))
    first = F.struct(*[F.lit(v).alias(k) for k, v in header["at"].asDict().items()])
    cells = lines.filter(F.col("at") > first).select(F.from_csv("value", schema, {"sep": sep}).alias("row"))
    return cells.select(
        *[F.col(f"row.{old}").alias(new) for old, new in REGISTRY_COLUMNS.items()]
    ).filter(F.col("code").isNotNull())


def registry_lookup(registry: DataFrame, vintage: int | None = None) -> Lookup:
    """Checked registry. ``vintage`` picks one edition when several are stacked."""
    if vintage is not None:
        registry = registry.filter(F.col("vintage") == vintage).drop("vintage")
    return Lookup.of(registry.select(*REGISTRY_COLUMNS.values()), "code")


def communes_of(registry: Lookup, epci: str) -> Lookup:
    """The communes of one group."""
    return registry.where(F.col("epci") == epci)


def epci_choices(registry: DataFrame) -> DataFrame:
    """Every group name once, in alphabetical order."""
    return registry.select("epci").distinct().orderBy("epci")
