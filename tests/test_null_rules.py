"""Missing keys, weights and codes, on hand-made frames."""

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from navette.functions import in_set, ratio, recode_mode, row_sum, wsum
from navette.operators import flows, od, residency, shares


@pytest.fixture(scope="module")
def null_keys(make_flux):
    return make_flux(
        [
            ("A", "B", 2.0, "1", 2018),
            (None, "B", 3.0, "1", 2018),
            ("A", None, 4.0, "2", 2018),
            (None, None, 5.0, "2", 2018),
            ("Z", "A", 1.0, "3", 2018),
        ]
    )


def test_membership_of_null_is_false_and_its_negation_keeps_the_row(spark):
    frame = spark.createDataFrame([("A",), (None,), ("Q",)], "c STRING")
    assert frame.filter(~in_set(F.col("c"), ["A"])).count() == 2
    assert frame.filter(in_set(F.col("c"), ["A"])).count() == 1


def test_sum_of_missing_weights_is_zero(make_flux):
    frame = make_flux([("A", "B", None, "1", 2018), ("A", "B", None, "1", 2018), ("B", "A", None, "1", 2018), ("B", "A", 2.5, "1", 2018)])
    found = as_dict(flows.totals(frame, "resid_code"), "resid_code")
    assert found[("A",)]["flow"] == 0.0 and found[("A",)]["n_obs"] == 2
    assert found[("B",)]["flow"] == 2.5


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1] * 10 + [1e9, -1e9]
    one = spark.createDataFrame([(v,) for v in values], "w DOUBLE").coalesce(1)
    other = spark.createDataFrame([(v,) for v in reversed(values)], "w DOUBLE").coalesce(1)
    total = wsum("w", exact=True)
    assert one.agg(total).first()[0] == other.agg(total).first()[0] == 1.0


def test_null_residence_finds_its_total(null_keys):
    found = shares.mode_shares(null_keys, "year", "resid_code").collect()
    outside = {row["mode"]: row for row in found if row["resid_code"] is None}
    assert {mode: row["total"] for mode, row in outside.items()} == {"Aucun": 8.0, "Marche": 8.0}
    assert outside["Aucun"]["share"] == 3.0 / 8.0


def test_outsiders_form_one_null_group(null_keys, registry):
    members = registry.where(F.col("epci") == "Nord")
    chosen = flows.outsiders_to_null(flows.touching(null_keys, members))
    found = as_dict(flows.totals(chosen, "resid_code"), "resid_code")
    assert found[(None,)]["flow"] == 4.0
    assert found[("A",)]["flow"] == 6.0
    assert chosen.count() == 4  # the row without any known end is not touched


def test_unlisted_code_keeps_its_value_and_null_stays(make_flux):
    rows = [("A", "B", 1.0, code, 2018) for code in ["1", "2", "3", "4", "5", "6", "7", "Z", None]]
    modes = {row["mode_code"]: row["mode"] for row in make_flux(rows).collect()}
    assert modes == {
        "1": "Aucun",
        "2": "Marche",
        "3": "Vélo",
        "4": "Moto",
        "5": "Voiture",
        "6": "TC",
        "7": "7",
        "Z": "Z",
        None: None,
    }


def test_codes_of_2016_stay_raw_and_are_flagged(make_flux):
    found = as_dict(make_flux([("A", "B", 1.0, "3", 2016), ("A", "B", 1.0, "3", 2017)]), "year")
    assert found[(2016,)]["mode"] == "3" and not found[(2016,)]["mode_comparable"]
    assert found[(2017,)]["mode"] == "Vélo" and found[(2017,)]["mode_comparable"]


def test_one_label_table_for_every_year_on_request(spark):
    frame = spark.createDataFrame([("3", 2016)], "c STRING, y INT")
    assert frame.select(recode_mode(F.col("c"), F.col("y"), year_labels={})).first()[0] == "Vélo"


def test_leading_zeros_distinguish_communes(make_flux, registry):
    frame = make_flux([("01004", "1004", 1.0, "1", 2018)])
    row = flows.label_ends(frame, registry).first()
    assert (row["resid_name"], row["work_name"]) == ("Ambérieu", "Autre")


def test_zero_total_gives_no_share(spark):
    frame = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "p DOUBLE, t DOUBLE")
    assert [r[0] for r in frame.select(ratio(F.col("p"), F.col("t"))).collect()] == [None, 0.5]


def test_row_sum_skips_missing(spark):
    frame = spark.createDataFrame([(1.0, None)], "a DOUBLE, b DOUBLE")
    assert frame.select(row_sum("a", "b")).first()[0] == 1.0


def test_wide_keeps_absent_apart_from_zero(make_flux):
    frame = make_flux(
        [
            ("A", "B", None, "1", 2018),
            ("A", "B", 2.0, "2", 2018),
            ("A", "B", 3.0, "7", 2018),
            ("A", "B", 4.0, None, 2018),
        ]
    )
    row = od.with_row_total(od.od_wide(frame, "resid_code", "work_code")).first()
    assert row["aucun"] == 0.0 and row["velo"] is None
    assert row["other"] == 7.0
    assert row["total"] == row["total_of_modes"] == 9.0


def test_counts_treat_missing_residence_as_outside(null_keys, registry):
    members = registry.where(F.col("epci") == "Nord")
    row = residency.headline_counts(flows.touching(null_keys, members), "year").first()
    assert row["n_touching"] == 4
    assert row["n_residents"] == 2
    assert row["n_workers"] == 3
    assert row["n_both"] == 1
    assert row["n_incoming"] == 2


def test_membership_stats_per_work_commune(null_keys, registry):
    members = registry.where(F.col("epci") == "Nord")
    found = as_dict(residency.membership_stats(flows.touching(null_keys, members)), "work_code")
    assert found[("B",)]["n_resid"] == 1
    assert found[("B",)]["n_work_not_resid"] == 1
    assert found[(None,)]["n_work"] == 0


def test_own_commune_is_not_membership(make_flux, registry):
    frame = make_flux(
        [
            ("A", "A", 1.0, "1", 2018),
            ("B", "A", 1.0, "1", 2018),
            ("Z", "A", 1.0, "1", 2018),
            (None, "A", 1.0, "1", 2018),
        ]
    )
    members = registry.where(F.col("epci") == "Nord")
    row = residency.work_commune_residency(flows.touching(frame, members), members, "year").first()
    assert (row["n_total"], row["n_resident_in_epci"], row["n_nonresident"]) == (4, 2, 2)
    assert row["n_own_commune"] == 1
    assert row["share_nonresident"] == 0.5
