"""Inputs that once lost rows or cells without an error."""

import zipfile

import pytest
from conftest import as_dict

from navette.operators.reconcile import reconcile
from navette.sources import archive, delimited, geojson

SQUARE = "[[[0,0],[1,0],[1,1],[0,0]]]"
FEATURE = '{"type":"Feature","properties":{"code":"%s","nom":"n"},"geometry":{"type":"%s","coordinates":%s}}'


def test_multipolygons_are_kept(spark, tmp_path):
    lines = [FEATURE % ("A", "Polygon", SQUARE), FEATURE % ("B", "MultiPolygon", f"[{SQUARE},{SQUARE}]")]
    (tmp_path / "c.json").write_text("\n".join(lines))
    found = as_dict(geojson.commune_contours(geojson.read_features(spark, str(tmp_path / "c.json"))), "code")
    ring = found["A",].wkt.removeprefix("POLYGON ")
    assert found["B",].wkt == f"MULTIPOLYGON ({ring}, {ring})" and ring.startswith("((0.000000 0.000000, ")


@pytest.mark.parametrize("text", ['{\n "type": "Feature"\n}', "not json", '{"other": 1}'])
def test_geojson_that_is_not_one_feature_a_line_fails(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|Malformed|neither a feature"):
        geojson.read_features(spark, str(tmp_path / "c.json")).collect()


def test_padded_codes_and_bad_weights(spark, tmp_path):
    text = 'COMMUNE;DCLT;IPONDI;TRANS\n A ;"B ";1.5;1\nA;B;2,5;1\nA;B;NA;1\nA;B;;1\n'
    (tmp_path / "f.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as out:
        out.writestr("f.csv", text)
    plain = delimited.read_flux(spark, str(tmp_path / "f.csv")).collect()
    zipped = archive.read_flux_zip(archive.read_zip_archives(spark, str(tmp_path / "f.zip")), "*.csv").collect()
    for rows in (plain, zipped):
        assert {(r.resid_code, r.work_code) for r in rows} == {("A", "B")}
        assert [r.weight for r in rows] == [1.5, None, None, None]
    counts = delimited.unparsed_cells(spark, str(tmp_path / "f.csv"), {"COMMUNE": "string", "IPONDI": "double"})
    assert tuple(counts.first()) == (0, 1)


def test_reconcile_matches_missing_ends(spark):
    ours = spark.createDataFrame([(None, "B", 3.0), ("A", "B", 1.0)], "resid_code string, work_code string, flow double")
    theirs = spark.createDataFrame([(None, "B", 3.0), ("C", None, 2.0)], "resid_code string, work_code string, published double")
    status = {(r.resid_code, r.work_code): r.status for r in reconcile(ours, theirs).collect()}
    assert status == {(None, "B"): "equal", ("A", "B"): "not published", ("C", None): "not computed"}
