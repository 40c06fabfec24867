import pytest
from conftest import as_dict
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from navette.operators import corrections, flows
from navette.schemas import MART_SCHEMA
from navette.sources import corrections as stored
from navette.sources import mart

OLD = [
    ("A", "B", 2.0, "1", 2018),
    ("A", "B", 3.0, "1", 2018),
    ("C", "A", 1.5, "3", 2018),
    (None, "Z", 1.0, None, 2018),
    ("D", "D", None, "2", 2018),
]
OUT = [("A", "B", 3.0, "1", 2018), ("C", "A", 1.5, "3", 2018), (None, "Z", 1.0, None, 2018)]
IN = [("A", "B", 7.25, "1", 2018), ("B", "Z", 4.0, "2", 2018), (None, "Z", 2.0, None, 2018)]
NEW = [OLD[0], OLD[4], *IN]


def cells(frame):
    return sorted((tuple(r) for r in frame.select(*MART_SCHEMA.names).collect()), key=str)


def test_corrected_year_equals_a_full_rebuild(make_flux, registry):
    old, new = (flows.flow_mart(make_flux(rows), registry) for rows in (OLD, NEW))
    change = corrections.correction(make_flux(OUT), make_flux(IN), registry)
    assert cells(corrections.corrected(old, change)) == cells(new)
    found = as_dict(change, "resid_code", "work_code")
    assert (found[("A", "B")]["flow"], found[("A", "B")]["n_obs"]) == (4.25, 0)
    assert found[(None, "Z")]["flow"] == 1.0 and len(found) == 4


def test_rows_on_both_sides_change_nothing(make_flux, registry):
    assert corrections.correction(make_flux(OUT), make_flux(OUT), registry).count() == 0
    with pytest.raises(ValueError):
        corrections.correction(None, None, registry)


def test_withdrawing_more_than_there_is_stops_the_query(make_flux, registry):
    old = flows.flow_mart(make_flux(OLD), registry)
    change = corrections.correction(make_flux([("B", "C", 1.0, "1", 2018)]), None, registry)
    with pytest.raises(PySparkException, match="more rows withdrawn"):
        corrections.corrected(old, change).collect()


def test_stored_corrections_read_compacted_and_as_they_were(spark, tmp_path, make_flux, registry):
    path, built = str(tmp_path / "years"), []

    def change(out, come):
        def build():
            built.append(1)
            return corrections.correction(make_flux(out) if out else None, make_flux(come) if come else None, registry)

        return build

    first = flows.flow_mart(make_flux(OLD), registry)
    with pytest.raises(ValueError, match="no table"):
        stored.publish_correction(spark, path, 2018, 1, change(OUT, IN))
    stored.publish_base(spark, path, 2018, lambda: first)
    stored.publish_correction(spark, path, 2018, 1, change(OUT, IN))
    stored.publish_correction(spark, path, 2018, 1, change(OUT, IN))  # sent again
    with pytest.raises(ValueError, match="next correction of 2018 is 2"):
        stored.publish_correction(spark, path, 2018, 3, change(OUT, IN))
    assert len(built) == 1
    new = cells(flows.flow_mart(make_flux(NEW), registry))
    assert cells(stored.read_corrected(spark, path, 2018)) == new
    assert cells(stored.read_corrected(spark, path, 2018, upto=0)) == cells(first)
    assert cells(stored.compact(spark, path, 2018)) == new
    # a correction after the new base adds to it, and earlier ones are not added twice
    stored.publish_correction(spark, path, 2018, 2, change([("B", "Z", 4.0, "2", 2018)], None))
    last = [row for row in NEW if row[:2] != ("B", "Z")]
    want = cells(flows.flow_mart(make_flux(last), registry))
    assert cells(stored.read_corrected(spark, path, 2018)) == want
    assert cells(stored.read_corrected(spark, path, 2018, upto=1)) == new


def test_filters_reach_the_base_and_each_correction(spark, tmp_path, make_flux, registry):
    paths = [str(tmp_path / name) for name in ("base", "one")]
    mart.write_mart(flows.flow_mart(make_flux(OLD), registry), paths[0])
    mart.write_mart(corrections.correction(make_flux(OUT), make_flux(IN), registry), paths[1])
    whole = corrections.corrected(*(mart.read_mart(spark, p) for p in paths))
    plan = whole.where(F.col("resid_epci") == "Nord").where("year = 2018")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 2
    assert all("EqualTo(resid_epci,Nord)" in s and "(year" in s.split("PartitionFilters")[1].split("PushedFilters")[0] for s in scans)
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
