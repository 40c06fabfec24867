"""Corrections of the years of a mart, each stored with a receipt, read together or written into a new copy.

Below ``path`` a year has a base table and numbered corrections. Each is published once under its own
request, so a correction that is sent twice counts once, and one that was interrupted is written again. ``compact`` writes
base and corrections into a new base that names the number it includes; readers add only later ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from navette.operators.corrections import corrected
from navette.schemas import MART_SCHEMA
from navette.sources.mart import read_mart, write_mart
from navette.sources.published import publish_if_absent, published_requests


def _base(year: int, includes: int) -> str:
    return json.dumps({"year": year, "base": includes})


def _delta(year: int, number: int) -> str:
    return json.dumps({"year": year, "correction": number})


def _stored(spark: SparkSession, path: str, year: int) -> tuple[dict[int, str], dict[int, str]]:
    """Folders of the bases of a year by the number they include, and of its corrections by number."""
    bases, deltas = {}, {}
    for request, folder in published_requests(spark, path, lambda r: json.loads(r)["year"] == year).items():
        what = json.loads(request)
        if "base" in what:
            bases[what["base"]] = folder
        else:
            deltas[what["correction"]] = folder
    return bases, deltas


def publish_base(spark: SparkSession, path: str, year: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The first table of a year, written from ``build()`` if it is not there."""
    return publish_if_absent(spark, path, MART_SCHEMA, lambda folder: write_mart(build(), folder), _base(year, 0))


def publish_correction(spark: SparkSession, path: str, year: int, number: int, build: Callable[[], DataFrame]) -> DataFrame:
    """Correction ``number`` (1, 2, ...) of a year, as ``operators.corrections.correction`` makes it; sent again, it is not built."""
    bases, deltas = _stored(spark, path, year)
    if not bases:
        raise ValueError(f"{path} holds no table of {year} to correct")
    last = max([*deltas, *bases])
    if not 1 <= number <= last + 1:
        raise ValueError(f"the next correction of {year} is {last + 1}, not {number}")

    def write(folder: str) -> None:
        write_mart(build().where(f"year = {int(year)}"), folder)

    return publish_if_absent(spark, path, MART_SCHEMA, write, _delta(year, number))


def read_corrected(spark: SparkSession, path: str, year: int, upto: int | None = None, exact: bool = False) -> DataFrame:
    """The table of a year with its corrections, or with those up to a number, as it was then."""
    bases, deltas = _stored(spark, path, year)
    last = max([0, *deltas, *bases]) if upto is None else upto
    usable = [number for number in bases if number <= last]
    if not usable:
        raise ValueError(f"{path} holds no table of {year}")
    start = max(usable)
    lost = [number for number in range(start + 1, last + 1) if number not in deltas]
    if lost:
        raise ValueError(f"{path} lacks corrections {lost} of {year}")
    later = [read_mart(spark, deltas[number]) for number in sorted(deltas) if start < number <= last]
    base = read_mart(spark, bases[start])
    return corrected(base, *later, exact=exact) if later else base


def compact(spark: SparkSession, path: str, year: int, exact: bool = False) -> DataFrame:
    """Write a year and all its corrections as a new base; frames on the older tables stay readable."""
    bases, deltas = _stored(spark, path, year)
    last = max([0, *deltas, *bases])
    whole = read_corrected(spark, path, year, last, exact)
    return publish_if_absent(spark, path, MART_SCHEMA, lambda folder: write_mart(whole, folder), _base(year, last))
