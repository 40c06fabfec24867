"""Codes and labels of the survey year."""

import pytest
from conftest import as_dict

from navette.operators import editions
from navette.operators.lookup import LookupKeyError


@pytest.fixture(scope="module")
def years(spark):
    return spark.createDataFrame([(2016,), (2018,), (None,), (2020,)], "year INT")


def test_editions_hold_up_to_their_last_year(spark, years):
    rows = [("A", "Old", "N", 1900, 2018), ("A", "New", "S", 2018, None), ("B", "Gone", "N", 1950, 2017), ("C", "Late", "S", 2030, None)]
    table = spark.createDataFrame(rows, "code STRING, name STRING, epci STRING, valid_from INT, valid_to INT")
    flux = spark.createDataFrame(
        [(y, c, "A", "m", 1.0, 1) for y in (2016, 2018, None) for c in ("A", "B", None, "C")],
        "year INT, resid_code STRING, work_code STRING, mode STRING, flow DOUBLE, n_obs BIGINT",
    )
    found = as_dict(editions.label_ends_as_of(flux, editions.editions_by_year(table, years)), "year", "resid_code")
    assert len(found) == 12
    names = {k: (r["resid_name"], r["resid_epci"], r["work_name"]) for k, r in found.items()}
    assert names[(2016, "A")] == ("Old", "N", "Old") and names[(2018, "A")] == ("New", "S", "New")
    assert names[(2016, "B")][0] == "Gone" and names[(2018, "B")][0] is None
    assert names[(2018, "C")][0] is None and names[(None, "A")] == (None, None, None)


def test_overlapping_editions_are_refused(spark, years):
    rows = [("A", "x", "N", 2000, 2019), ("A", "y", "N", 2018, None)]
    table = spark.createDataFrame(rows, "code STRING, name STRING, epci STRING, valid_from INT, valid_to INT")
    with pytest.raises(LookupKeyError, match="2018"):
        editions.editions_by_year(table, years)


def test_chains_of_changes_are_followed_by_year(spark, years):
    rows = [("A", "B", 2017), ("B", "C", 2019), ("X", "Y", 2018), ("Y", "Z", 2018), ("Q", "R", 2040)]
    changes = editions.changes_by_year(spark.createDataFrame(rows, "old_code STRING, new_code STRING, since INT"), years)
    flux = spark.createDataFrame(
        [(y, c, None, 1.0) for y in (2016, 2018, 2020) for c in ("A", "B", "X", "Y", "Q", "O")],
        "year INT, resid_code STRING, work_code STRING, weight DOUBLE",
    )
    got = {(r["year"], i): r["resid_code"] for i, r in enumerate(editions.codes_as_of(flux, changes).collect())}
    by_year = {y: sorted(v for (z, _), v in got.items() if z == y) for y in (2016, 2018, 2020)}
    assert by_year == {
        2016: sorted("ABXYQO"), 2018: sorted(["B", "B", "Z", "Z", "Q", "O"]), 2020: sorted(["C", "C", "Z", "Z", "Q", "O"])
    }


def test_circular_changes_are_refused(spark, years):
    table = spark.createDataFrame([("A", "B", 2016), ("B", "A", 2018)], "old_code STRING, new_code STRING, since INT")
    with pytest.raises(ValueError, match="itself"):
        editions.changes_by_year(table, years)


def test_no_year_gives_an_empty_lookup(spark):
    table = spark.createDataFrame([("A", "x", "N", 2000, 2019)], "code STRING, name STRING, epci STRING, valid_from INT, valid_to INT")
    assert editions.editions_by_year(table, spark.createDataFrame([], "year INT")).rows == 0
