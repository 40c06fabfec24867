"""Delimited text: named columns only, declared types, missing markers nulled."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from navette.operators.flows import with_mode
from navette.schemas import FLOW_FILE_COLUMNS, FLOW_FILE_TYPES

# Cells that stand for a missing value.
MISSING = ("", "NA")


def _as_text(spark: SparkSession, path: str | list[str], sep: str, trim: bool) -> DataFrame:
    return (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
        .csv(path)
    )


def _unparsed(cell: Column, kind: str) -> Column:
    return F.count_if(cell.isNotNull() & ~cell.isin(*MISSING) & cell.try_cast(kind).isNull())


def unparsed_cells(
    spark: SparkSession, path: str | list[str], types: Mapping[str, str], sep: str = ";"
) -> DataFrame:
    """One row: for each column, how many cells hold something that is not of its type.

    A scan of its own; ``typed`` counts the same cells while it reads.
    """
    raw = _as_text(spark, path, sep, True)
    return raw.agg(*[_unparsed(F.btrim(F.col(f"`{name}`")), kind).alias(name) for name, kind in types.items()])


def typed(
    raw: DataFrame, types: Mapping[str, str], trim: bool = True, observed: Observation | None = None
) -> DataFrame:
    """Text columns cast to their types; missing markers and cells not of their type are missing.

    ``observed`` gets, in the pass that reads the rows, their number (``rows``) and for each column that is not
    text how many cells held something not of its type.
    """
    raw = raw.select(*[F.col(f"`{name}`") for name in types])
    columns, bad = [], []
    for name, kind in types.items():
        cell = F.btrim(F.col(f"`{name}`")) if trim else F.col(f"`{name}`")
        present = F.when(~cell.isin(*MISSING), cell)
        columns.append(present.try_cast(kind).alias(name))
        if kind != "string":
            bad.append(_unparsed(cell, kind).alias(name))
    if observed is not None:
        raw = raw.observe(observed, F.count(F.lit(1)).alias("rows"), *bad)
    return raw.select(*columns)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    types: Mapping[str, str],
    sep: str = ";",
    trim: bool = True,
    observed: Observation | None = None,
) -> DataFrame:
    """The columns named in ``types``, cast to the declared type.

    Every column is read as text under the name in the header and cast after
    selection, so columns are found by name wherever they stand, and codes keep
    their leading zeros. A cell that is not of its type is missing and counted by ``observed`` (see ``typed``). A file
    whose header differs from the first one fails instead of giving shifted values.
    """
    return typed(_as_text(spark, path, sep, trim), types, trim, observed)


def read_flux(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ";",
    trim: bool = True,
    observed: Observation | None = None,
) -> DataFrame:
    """One yearly flow file (or several with the same layout), four columns wide."""
    rows = read_delimited(spark, path, FLOW_FILE_TYPES, sep, trim, observed)
    return rows.withColumnsRenamed(FLOW_FILE_COLUMNS)


def read_flux_years(
    path_template: str, years: Iterable[int], read: Callable[[str], DataFrame]
) -> DataFrame:
    """Yearly files stacked by column name, each row tagged with its year and mode.

    ``path_template`` holds ``{year}``. Every year is read on its own, so files of
    different years may order their columns differently; the stack is one lazy plan.
    """
    stacked = None
    for year in years:
        one = read(path_template.format(year=year)).withColumn("year", F.lit(int(year)))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no year given")
    return with_mode(stacked)


def read_mode_labels(
    spark: SparkSession,
    path: str,
    code: str = "COD_MOD",
    label: str = "LIB_MOD",
    variable: tuple[str, str] | None = ("COD_VAR", "TRANS"),
    sep: str = ";",
) -> DataFrame:
    """Code-label table of one survey variable, usable in place of the fixed labels."""
    types = {code: "string", label: "string"}
    if variable is not None:
        types[variable[0]] = "string"
    table = read_delimited(spark, path, types, sep, trim=True)
    if variable is not None:
        table = table.filter(F.col(variable[0]) == variable[1])
    return table.select(F.col(code).alias("mode_code"), F.col(label).alias("mode"))
