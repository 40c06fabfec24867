"""Transport modes: fixed code labels and the recode expression."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mode code to mode label.
MODE_LABELS = {
    "1": "Aucun",
    "2": "Marche",
    "3": "Vélo",
    "4": "Moto",
    "5": "Voiture",
    "6": "TC",
}

MODES = list(MODE_LABELS.values())

# Mode label to the column that holds it in wide tables.
MODE_COLUMNS = {
    "Aucun": "aucun",
    "Marche": "marche",
    "Vélo": "velo",
    "Moto": "moto",
    "Voiture": "voiture",
    "TC": "tc",
}

# Bicycles became a category of their own in 2017, so codes of the 2016 survey
# do not mean what MODE_LABELS says. They keep their code.
YEAR_LABELS: dict[int, dict[str, str]] = {2016: {}}


def _lookup(labels: Mapping[str, str], code: Column) -> Column:
    if not labels:
        return code
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(pairs, code), code)


def recode_mode(
    code: Column,
    year: Column | None = None,
    labels: Mapping[str, str] = MODE_LABELS,
    year_labels: Mapping[int, Mapping[str, str]] = YEAR_LABELS,
) -> Column:
    """Label of a mode code; an unlisted code keeps its value, NULL stays NULL.

    ``year_labels`` replaces the label table for single survey years; pass an
    empty mapping to use one table for every year.
    """
    recoded = _lookup(labels, code)
    if year is None:
        return recoded
    for special_year, special in year_labels.items():
        recoded = F.when(year == special_year, _lookup(special, code)).otherwise(recoded)
    return recoded


def mode_comparable(year: Column) -> Column:
    """FALSE for survey years whose mode codes follow another list."""
    return ~F.coalesce(year.isin(list(YEAR_LABELS)), F.lit(False))
