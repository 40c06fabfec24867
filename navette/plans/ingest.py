"""Batch ingest: yearly flow files and a registry sheet into the flow mart.

With ``--rows`` the labelled survey rows are written as well, and the mart of a year is summed from
them, so that the files of a year are parsed once.

    spark-submit --py-files navette.zip navette/plans/ingest.py \\
        --files '…/FD_MOBPRO_{year}.csv' --years 2016 2017 2018 2019 \\
        --registry '…/communes.csv' --mart '…/flow_mart' [--rows '…/enriched'] [--max-unparsed 0]
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession

from navette.operators.flows import flow_mart, label_ends
from navette.operators.lookup import Lookup
from navette.sources.archive import read_flux_zip, read_zip_archives
from navette.sources.delimited import read_flux, read_flux_years
from navette.sources.enriched import build_enriched_if_absent
from navette.sources.mart import build_mart_if_absent
from navette.sources.registry import read_registry_sheet, registry_lookup
from navette.sources.shared import fresh_path

# Fixed value: how the flow file of a year is called inside its archive.
MEMBER = "FD_MOBPRO_*.csv"

#: Cells of a year's files that may hold something not of their type; such a weight would count as nothing.
MAX_UNPARSED = 0

log = logging.getLogger(__name__)


class UnparsedCells(ValueError):
    """The files hold more cells that are not of their type than the caller allows."""


def read_years(
    spark: SparkSession,
    template: str,
    years: Iterable[int],
    member: str = MEMBER,
    observed: Observation | None = None,
) -> DataFrame:
    """Survey rows of all years; a template that ends in ``.zip`` names archives. ``observed`` takes a single year."""

    def read(path: str) -> DataFrame:
        if template.endswith(".zip"):
            return read_flux_zip(read_zip_archives(spark, path), member, observed=observed)
        return read_flux(spark, path, observed=observed)

    return read_flux_years(template, years, read)


def check_cells(observed: Observation, year: int, most: int) -> dict[str, int]:
    """The counts of a finished read; fails if more than ``most`` cells were not of their type."""
    counts = dict(observed.get)
    rows = counts.pop("rows")
    bad = {name: n for name, n in counts.items() if n}
    log.info("%s: %s rows, cells not of their type: %s", year, rows, bad or "none")
    if sum(bad.values()) > most:
        raise UnparsedCells(f"{year}: {rows} rows hold {bad} cells that are not of their type; {most} are allowed")
    return counts


def labelled_flux(
    spark: SparkSession,
    template: str,
    years: Iterable[int],
    registry_sheet: str,
    observed: Observation | None = None,
) -> DataFrame:
    """Survey rows of all years with names and groups of both ends."""
    lookup = _registry(spark, registry_sheet)
    return label_ends(read_years(spark, template, years, observed=observed), lookup)


def _registry(spark: SparkSession, sheet: str) -> Lookup:
    return registry_lookup(read_registry_sheet(spark, sheet))


def _each_year(years: Iterable[int], inputs: tuple[str, str], publish) -> DataFrame:
    """Tables of single years stacked, so that another year, or one whose files were replaced, builds that year only."""
    tables = [publish(year, json.dumps([year, *inputs])) for year in sorted(set(years))]
    return reduce(DataFrame.unionByName, tables)


def build_rows(
    spark: SparkSession,
    template: str,
    years: Iterable[int],
    registry_sheet: str,
    path: str,
    max_unparsed: int = MAX_UNPARSED,
) -> DataFrame:
    """The labelled survey rows of ``years`` below ``path``; years not there yet are written."""
    inputs = (spark, template, registry_sheet, path, max_unparsed)
    return _each_year(years, (template, registry_sheet), lambda year, request: _rows_of(year, request, *inputs))


def _rows_of(
    year: int, request: str, spark: SparkSession, template: str, registry_sheet: str, path: str, max_unparsed: int
) -> DataFrame:
    """One year's rows: parsed once into the shared folder, where the clustered copy is written from."""

    def parsed() -> tuple[DataFrame, Lookup]:
        seen = Observation(f"cells-{year}")
        rows = labelled_flux(spark, template, [year], registry_sheet, seen)
        staged = fresh_path(spark, f"rows-{year}")
        rows.write.parquet(staged)
        check_cells(seen, year, max_unparsed)
        return spark.read.schema(rows.schema).parquet(staged), _registry(spark, registry_sheet)

    return build_enriched_if_absent(spark, path, parsed, request, [template.format(year=year), registry_sheet])


def build(
    spark: SparkSession,
    template: str,
    years: Iterable[int],
    registry_sheet: str,
    path: str,
    rows_path: str | None = None,
    max_unparsed: int = MAX_UNPARSED,
) -> DataFrame:
    """The flow mart of ``years`` below ``path``; years not there yet are built.

    With ``rows_path`` the labelled rows of a year are published there first, and its mart is summed from
    them; otherwise from the files. Either way the files of a year are parsed once, and a year whose cells exceed
    the limit leaves no receipt.
    """

    def publish(year: int, request: str) -> DataFrame:
        seen = Observation(f"cells-{year}")

        def mart() -> DataFrame:
            if rows_path:
                flux = _rows_of(year, request, spark, template, registry_sheet, rows_path, max_unparsed)
            else:
                flux = read_years(spark, template, [year], MEMBER, seen)
            return flow_mart(flux, _registry(spark, registry_sheet))

        check = None if rows_path else lambda: check_cells(seen, year, max_unparsed)
        return build_mart_if_absent(spark, path, mart, request, check, [template.format(year=year), registry_sheet])

    return _each_year(years, (template, registry_sheet), publish)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--files", required=True, help="path with {year}, .csv or .zip")
    parser.add_argument("--years", required=True, type=int, nargs="+")
    parser.add_argument("--registry", required=True)
    parser.add_argument("--mart", required=True)
    parser.add_argument("--rows")
    parser.add_argument("--max-unparsed", type=int, default=MAX_UNPARSED)
    chosen = parser.parse_args()
    spark = SparkSession.builder.appName("navette-ingest").getOrCreate()
    logging.basicConfig(level=logging.INFO)
    build(spark, chosen.files, chosen.years, chosen.registry, chosen.mart, chosen.rows, chosen.max_unparsed)
    spark.stop()


if __name__ == "__main__":
    main()
