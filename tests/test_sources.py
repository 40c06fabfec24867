import json
import zipfile
from pathlib import Path
from urllib.parse import urlparse

import pytest
from conftest import as_dict

from navette.operators import flows
from navette.plans import ingest
from navette.sources import archive, delimited, geojson, mart, published, registry, shared

CSV = (
    "AGEREVQ;DCLT;COMMUNE;IPONDI;TRANS\n"
    '25;"01004";1004;1.5;1\n'
    "30;NA;01004;2;\n"
    "40;44109;;;2\n"
    "50; 44109 ;44109;abc;3\n"
)


@pytest.fixture
def flow_csv(tmp_path):
    path = tmp_path / "FD_MOBPRO_2018.csv"
    path.write_text(CSV)
    return path


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_columns_are_found_by_name_and_missing_markers_are_null(spark, flow_csv):
    found = rows(delimited.read_flux(spark, str(flow_csv)))
    assert found == sorted(
        [
            ("1004", "01004", 1.5, "1"),
            ("01004", None, 2.0, None),
            (None, "44109", None, "2"),
            ("44109", "44109", None, "3"),
        ],
        key=str,
    )


def test_untrimmed_scan_on_request(spark, flow_csv):
    found = as_dict(delimited.read_flux(spark, str(flow_csv), trim=False), "mode_code")
    assert found[("3",)]["work_code"] == " 44109 "


def test_only_named_columns_are_read(spark, flow_csv):
    plan = delimited.read_flux(spark, str(flow_csv))._jdf.queryExecution().executedPlan().toString()
    assert "AGEREVQ" not in plan.split("ReadSchema")[1]


def test_years_may_order_their_columns_differently(spark, tmp_path):
    (tmp_path / "f_2016.csv").write_text("COMMUNE;DCLT;IPONDI;TRANS\nA;B;1;3\n")
    (tmp_path / "f_2017.csv").write_text("TRANS;IPONDI;X;DCLT;COMMUNE\n3;2;x;B;A\n")
    frame = ingest.read_years(spark, str(tmp_path / "f_{year}.csv"), [2016, 2017])
    found = as_dict(frame, "year")
    assert found[(2016,)]["weight"] == 1.0 and found[(2017,)]["weight"] == 2.0
    assert found[(2016,)]["mode"] == "3" and found[(2017,)]["mode"] == "Vélo"
    assert found[(2017,)]["resid_code"] == "A"


def test_no_year_is_an_error(spark):
    with pytest.raises(ValueError):
        ingest.read_years(spark, "x{year}", [])


def test_mode_label_table(spark, tmp_path):
    path = tmp_path / "varmod.csv"
    path.write_text("COD_VAR;LIB_VAR;COD_MOD;LIB_MOD\nTRANS;Mode;1;Aucun\nSEXE;Sexe;1;Homme\n")
    assert rows(delimited.read_mode_labels(spark, str(path))) == [("1", "Aucun")]


def test_named_member_of_an_archive(spark, tmp_path):
    path = tmp_path / "RP2018.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as target:
        target.writestr("Varmod.csv", "COD_VAR;COD_MOD\nTRANS;1\n")
        target.writestr("FD_MOBPRO_2018.csv", CSV)
    archives = archive.read_zip_archives(spark, str(tmp_path / "*.zip"))
    found = rows(archive.read_flux_zip(archives, "FD_MOBPRO_*.csv"))
    (tmp_path / "plain.csv").write_text(CSV)
    assert found == rows(delimited.read_flux(spark, str(tmp_path / "plain.csv")))


def test_registry_below_a_preamble(spark, tmp_path):
    path = tmp_path / "registry.csv"
    path.write_text(
        "Intercommunalité;;;\nau 01/01/2018;a;b;c\n;;;\nCode;Libellé;EPCI;Libellé\nx;y;z;t\n"
        "CODGEO;LIBGEO;EPCI;LIBEPCI\n01004;Ambérieu;200;Plaine\n69123;Lyon;200;Grand Lyon\n"
    )
    found = rows(registry.read_registry_sheet(spark, str(path)))
    assert found == [("01004", "Ambérieu", "Plaine"), ("69123", "Lyon", "Grand Lyon")]
    lookup = registry.registry_lookup(registry.read_registry_sheet(spark, str(path)))
    assert registry.communes_of(lookup, "Plaine").frame.count() == 1
    assert [r[0] for r in registry.epci_choices(lookup.frame).collect()] == ["Grand Lyon", "Plaine"]


def test_registry_with_quotes_and_another_separator(spark, tmp_path):
    path = tmp_path / "registry.csv"
    path.write_text('x|y\n"LIBEPCI"|"CODGEO"|"LIBGEO"\n"Plaine"|"01004"|"A|B"\n')
    assert rows(registry.read_registry_sheet(spark, str(path), "|")) == [("01004", "A|B", "Plaine")]


def test_registry_split_between_tasks(spark, tmp_path):
    lines = [f"junk{i};a;b" for i in range(300)]
    lines += ["CODGEO;LIBGEO;LIBEPCI"] + [f"{i:05d};n{i};e{i % 7}" for i in range(2000)]
    path = tmp_path / "registry.csv"
    path.write_text("\n".join(lines) + "\n")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "4096")
    spark.conf.set(names[1], "0")
    try:
        frame = registry.read_registry_sheet(spark, str(path))
        assert frame.rdd.getNumPartitions() > 3
        found = rows(frame)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert [r[0] for r in found] == [f"{i:05d}" for i in range(2000)]


def test_registry_without_header_is_an_error(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a;b\n")
    with pytest.raises(ValueError):
        registry.read_registry_sheet(spark, str(tmp_path / "r.csv"))


def test_registry_vintage(spark):
    frame = spark.createDataFrame(
        [("A", "x", "E", 2018), ("A", "x", "F", 2019)],
        "code STRING, name STRING, epci STRING, vintage INT",
    )
    assert registry.registry_lookup(frame, 2019).frame.first()["epci"] == "F"


def feature(code, kind, coordinates):
    return {
        "type": "Feature",
        "properties": {"code": code, "nom": "n", "surface": 3},
        "geometry": {"type": kind, "coordinates": coordinates},
    }


@pytest.mark.parametrize("whole_files", [False, True])
def test_geometry_is_joined_by_code(spark, tmp_path, registry, whole_files):
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    collection = {
        "type": "FeatureCollection",
        "features": [
            feature("A", "Point", [-1.5603, 47.2382]),
            feature("ZZ", "Point", [1, 2]),
            feature("C", "Polygon", square),
        ],
    }
    indent = 2 if whole_files else None
    (tmp_path / "a.json").write_text(json.dumps(collection, indent=indent))
    (tmp_path / "b.json").write_text(json.dumps(feature("B", "Point", [-1, 47]), indent=indent))
    features = geojson.read_features(spark, str(tmp_path / "*.json"), whole_files)
    points = as_dict(geojson.named_geometry(geojson.commune_points(features), registry), "code")
    assert set(points) == {("A",), ("B",)}
    assert points[("A",)]["name"] == "Alpha"
    assert points[("A",)]["wkt"] == "POINT (-1.560300 47.238200)"
    contours = geojson.named_geometry(geojson.commune_contours(features), registry).collect()
    assert [r["wkt"] for r in contours] == [
        "POLYGON ((0.000000 0.000000, 1.000000 0.000000, 1.000000 1.000000, 0.000000 0.000000))"
    ]


def test_mart_round_trip_and_single_build(spark, tmp_path, make_flux, registry):
    rows_in = [("A", "B", 2.0, "1", 2018), ("A", "B", 3.0, "1", 2018), (None, "Z", 1.0, None, 2019)]
    built = []

    def build():
        built.append(1)
        return flows.flow_mart(make_flux(rows_in), registry)

    path = str(tmp_path / "mart")
    first = rows(mart.build_mart_if_absent(spark, path, build))
    again = rows(mart.build_mart_if_absent(spark, path, build))
    assert first == again and len(built) == 1 and len(first) == 2
    assert published.rows_published(spark, path) == 2
    assert ("A", "B", "Aucun", 2, 5.0, "Alpha", "Nord", "Beta", "Nord", 2018) in first


def test_mart_without_receipt_is_built_again(spark, tmp_path, make_flux, registry):
    path = str(tmp_path / "mart")
    stale = flows.flow_mart(make_flux([("B", "A", 9.0, "1", 2018)]), registry)
    stale.select("resid_code").write.parquet(path)  # as an interrupted writer leaves it
    fresh = flows.flow_mart(make_flux([("A", "B", 2.0, "1", 2018)]), registry)
    found = mart.build_mart_if_absent(spark, path, lambda: fresh).collect()
    assert [(r["resid_code"], r["flow"]) for r in found] == [("A", 2.0)]


def test_mart_that_lost_a_file_is_built_again(spark, tmp_path, make_flux, registry):
    def build():
        return flows.flow_mart(make_flux([("A", "B", 2.0, "1", 2018), ("A", "B", 1.0, "1", 2019)]), registry)

    path = str(tmp_path / "mart")
    first = mart.build_mart_if_absent(spark, path, build)
    next(Path(urlparse(first.inputFiles()[0]).path).parent.glob("*.parquet")).unlink()
    again = mart.build_mart_if_absent(spark, path, build)
    assert again.count() == 2 and published.rows_published(spark, path) == 2


def test_added_year_builds_that_year_only(spark, yearly_files, monkeypatch):
    read = []
    whole = ingest.read_years
    monkeypatch.setattr(ingest, "read_years", lambda s, t, years, *m: read.append(list(years)) or whole(s, t, years, *m))
    given = (spark, str(yearly_files / "FD_MOBPRO_{year}.csv"))
    sheet, path = str(yearly_files / "communes.csv"), str(yearly_files / "mart")
    old = ingest.build(*given, [2016], sheet, path)
    both = ingest.build(*given, [2016, 2017], sheet, path)
    assert read == [[2016], [2017]]
    assert {r["year"] for r in both.collect()} == {2016, 2017}
    assert {r["year"] for r in old.collect()} == {2016}  # still readable


@pytest.fixture
def yearly_files(tmp_path):
    for year, extra in ((2016, "B;A;1;3\n"), (2017, "C;Z;2;3\nA;B;0.5;2\n")):
        text = "COMMUNE;DCLT;IPONDI;TRANS\nA;B;1.5;2\n" + extra
        (tmp_path / f"FD_MOBPRO_{year}.csv").write_text(text)
        with zipfile.ZipFile(tmp_path / f"RP{year}.zip", "w") as target:
            target.writestr(f"FD_MOBPRO_{year}.csv", text)
            target.writestr("Varmod.csv", "x\n1\n")
    sheet = tmp_path / "communes.csv"
    sheet.write_text("x\nCODGEO;LIBGEO;LIBEPCI\nA;Alpha;Nord\nB;Beta;Nord\nC;Gamma;Sud\n")
    return tmp_path


@pytest.mark.parametrize("template", ["FD_MOBPRO_{year}.csv", "RP{year}.zip"])
def test_ingest_from_files_to_mart(spark, yearly_files, template):
    found = ingest.build(
        spark,
        str(yearly_files / template),
        [2016, 2017],
        str(yearly_files / "communes.csv"),
        str(yearly_files / f"mart-{template[:2]}"),
    )
    cells = as_dict(found, "year", "resid_code", "work_code", "mode")
    assert len(cells) == 4
    assert cells[(2017, "A", "B", "Marche")]["flow"] == 2.0
    assert cells[(2017, "A", "B", "Marche")]["n_obs"] == 2
    assert cells[(2016, "A", "B", "2")]["resid_epci"] == "Nord"
    assert cells[(2017, "C", "Z", "Vélo")]["work_epci"] is None


def test_labelled_rows_keep_their_display_names_on_disk(spark, yearly_files):
    path = str(yearly_files / "rows")
    found = ingest.build_rows(
        spark,
        str(yearly_files / "FD_MOBPRO_{year}.csv"),
        [2016, 2017],
        str(yearly_files / "communes.csv"),
        path,
    )
    assert found.count() == 5
    assert {r["resid_name"] for r in found.collect()} == {"Alpha", "Beta", "Gamma"}
    stored = spark.read.parquet(found.inputFiles()[0].rsplit("/annee=", 1)[0])
    assert {"Commune de résidence", "Mode de transport", "annee"} <= set(stored.columns)
    pruned = flows.within(found, 2017, "Nord")
    assert [(r["resid_code"], r["weight"]) for r in pruned.orderBy("weight").collect()] == [
        ("A", 0.5),
        ("A", 1.5),
    ]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(epci_resid,Nord)" in plan and "annee" in plan.split("PartitionFilters")[1]


def test_differing_headers_under_one_path_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("COMMUNE;DCLT;IPONDI;TRANS\nA;B;1;3\n")
    (tmp_path / "b.csv").write_text("DCLT;COMMUNE;IPONDI;TRANS\nA;B;1;3\n")
    with pytest.raises(Exception, match="header"):
        delimited.read_flux(spark, str(tmp_path / "*.csv")).collect()


class Session:
    """As much of a session as choosing the folder needs."""

    def __init__(self, named=None, master="local[2]"):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master
        self.chosen = None

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, folder):
        self.chosen = folder


def test_shared_folder_is_the_one_the_session_names():
    session = Session("hdfs://cluster/checkpoints/", "spark://cluster")
    assert shared.shared_folder(session) == "hdfs://cluster/checkpoints"
    assert shared.fresh_path(session, "x").startswith("hdfs://cluster/checkpoints/navette/x-")


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session(master="yarn"))


def test_local_session_gets_one_temporary_folder():
    session = Session()
    assert shared.shared_folder(session) == shared.shared_folder(session) == session.chosen


def test_records_are_cut_where_they_end():
    import io

    body = 'a;b\n1;"x\ny;""z"\n2;plain\n3;"' + "w\n" * 40 + '"\n4;last'
    for most in (1, 3, 7, 20, 1000):
        header, *pieces = archive.record_pieces(io.BytesIO(body.encode()), most)
        assert header == b"a;b\n" and b"".join([header, *pieces]).decode() == body
        assert all(p.count(b'"') % 2 == 0 and p.endswith(b"\n") for p in pieces[:-1])
    assert len(pieces) == 1 and len(list(archive.record_pieces(io.BytesIO(body.encode()), 3))) > 3
    assert list(archive.record_pieces(io.BytesIO(b""))) == [b""]


def test_one_member_is_parsed_by_several_tasks(spark, tmp_path):
    lines = [f"{i % 97};{i % 89};{i}.5;{i % 7}" for i in range(20_000)]
    with zipfile.ZipFile(tmp_path / "RP2018.zip", "w", zipfile.ZIP_DEFLATED) as target:
        target.writestr("FD_MOBPRO_2018.csv", "COMMUNE;DCLT;IPONDI;TRANS\n" + "\n".join(lines) + "\n")
    archives = archive.read_zip_archives(spark, str(tmp_path / "*.zip"))
    names = ["spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"]
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "1m")
    spark.conf.set(names[1], "1m")
    try:
        from pyspark.sql import functions as F

        found = archive.read_flux_zip(archives, "FD_MOBPRO_*.csv", most=16_384)
        tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r["count"] for r in tasks) == 20_000 and len(tasks) > 2
    assert max(r["count"] for r in tasks) < 20_000 * 0.6


def test_zip_archives_round_trip(spark, tmp_path):
    frame = spark.range(5000).selectExpr("id AS COMMUNE", "'a;\"b\nc' AS DCLT", "id / 2 AS IPONDI", "'1' AS TRANS").repartition(3)
    folder = str(tmp_path / "zips")
    assert archive.write_zip_archives(frame, folder, "FD_MOBPRO.csv") == 3
    found = archive.read_flux_zip(archive.read_zip_archives(spark, f"{folder}/*.zip"), "*.csv", most=4096)
    assert {r["resid_code"] for r in found.collect()} == {str(i) for i in range(5000)}
    assert found.select("work_code").distinct().collect() == [('a;"b\nc',)]


@pytest.mark.parametrize("template", ["FD_MOBPRO_{year}.csv", "RP{year}.zip"])
@pytest.mark.parametrize("with_rows", [False, True])
def test_unparsed_weights_stop_the_ingest(spark, yearly_files, template, with_rows):
    text = "COMMUNE;DCLT;IPONDI;TRANS\nA;B;2,5;2\nB;A;1;3\nB;C;NA;3\nC;C;x;3\n"
    (yearly_files / "FD_MOBPRO_2018.csv").write_text(text)
    with zipfile.ZipFile(yearly_files / "RP2018.zip", "w") as target:
        target.writestr("FD_MOBPRO_2018.csv", text)
    sheet, path = str(yearly_files / "communes.csv"), str(yearly_files / "mart")
    given = (spark, str(yearly_files / template), [2018], sheet, path, str(yearly_files / "rows") if with_rows else None)
    with pytest.raises(ingest.UnparsedCells, match="4 rows hold {'IPONDI': 2}"):
        ingest.build(*given)
    request = json.dumps([2018, str(yearly_files / template), sheet])
    assert published.rows_published(spark, path, request) is None
    found = as_dict(ingest.build(*given, max_unparsed=2), "resid_code", "work_code")
    assert found[("B", "A")]["flow"] == 1.0 and found[("A", "B")]["flow"] == 0.0
    assert published.rows_published(spark, path, request) == 4


def test_rows_and_mart_come_from_one_parse(spark, yearly_files, monkeypatch):
    opened, plans = [], []
    real, write = delimited._as_text, mart.write_mart
    monkeypatch.setattr(delimited, "_as_text", lambda s, path, *a: opened.append(path) or real(s, path, *a))
    monkeypatch.setattr(
        mart, "write_mart", lambda m, p: plans.append(m._jdf.queryExecution().executedPlan().toString()) or write(m, p)
    )
    template, sheet = str(yearly_files / "FD_MOBPRO_{year}.csv"), str(yearly_files / "communes.csv")
    both = ingest.build(spark, template, [2016, 2017], sheet, str(yearly_files / "m1"), str(yearly_files / "rows"))
    assert opened == [template.format(year=y) for y in (2016, 2017)]
    assert len(plans) == 2 and not any("FileScan csv" in p.split("FileScan text")[0] for p in plans)
    alone = ingest.build(spark, template, [2016, 2017], sheet, str(yearly_files / "m2"))
    assert rows(both) == rows(alone)
    rows_only = ingest.build_rows(spark, template, [2016, 2017], sheet, str(yearly_files / "rows"))
    assert rows_only.count() == 5 and len(opened) == 4


def test_few_files_overlap_one_group_on_either_end(spark, tmp_path):
    import pyarrow.parquet as pq

    from navette.operators.lookup import Lookup
    from navette.sources import enriched

    table = Lookup.of(spark.createDataFrame([(f"c{i:02d}", f"n{i}", f"g{i // 2:02d}") for i in range(64)], "code STRING, name STRING, epci STRING"), "code")
    flux = spark.range(64 * 64 * 6).selectExpr(
        "format_string('c%02d', id % 64) AS resid_code", "format_string('c%02d', cast(id / 64 as int) % 64) AS work_code",
        "double(id) AS weight", "'1' AS mode_code", "2018 AS year", "'Aucun' AS mode",
    )
    # one pair of groups holds as many rows again as all others
    hot = spark.range(64 * 64 * 6).selectExpr("'c00' AS resid_code", "'c01' AS work_code", "double(id) AS weight", "'1' AS mode_code", "2018 AS year", "'Aucun' AS mode")
    path = str(tmp_path / "rows")
    enriched.write_enriched(flows.label_ends(flux.union(hot), table), path, table, files=32)
    ranges = []
    for file in Path(path).rglob("*.parquet"):
        part = pq.read_table(file, columns=["epci_resid", "epci_travail"])
        ranges.append([(min(c.to_pylist()), max(c.to_pylist()), len(c)) for c in part.columns])
    assert len(ranges) > 24 and max(r[0][2] for r in ranges) < 4 * 64 * 64 * 12 / 32  # no file holds the hot pair alone
    normal = [r for r in ranges if r[0][:2] != ("g00", "g00") or r[1][:2] != ("g00", "g00")]
    for group in ("g05", "g17", "g30"):
        for end in (0, 1):
            assert sum(r[end][0] <= group <= r[end][1] for r in normal) <= len(normal) / 2
        either = sum(any(low <= group <= high for low, high, _ in r) for r in normal)
        assert either <= 0.75 * len(normal)
    found = enriched.read_enriched(spark, path)
    assert found.count() == 2 * 64 * 64 * 6


def test_enriched_rows_are_ordered_by_key_and_hashed_by_codes_alone(spark):
    from navette.operators.lookup import Lookup
    from navette.sources import enriched

    table = Lookup.of(spark.createDataFrame([(f"c{i}", f"n{i}", f"g{i // 2}") for i in range(8)], "code STRING, name STRING, epci STRING"), "code")
    flux = spark.range(640).selectExpr(
        "concat('c', id % 9) AS resid_code", "concat('c', cast(id / 9 as int) % 9) AS work_code", "double(id % 50) AS weight",
        "'1' AS mode_code", "int(2017 + id % 2) AS year", "'Aucun' AS mode",
    )
    labelled = flows.label_ends(flux, table)
    found = enriched.dealt(labelled, table, files=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "epci" not in plan.split("xxhash64(")[1].split(")")[0] and "epci" not in plan.split("Sort [")[1].split("]")[0]
    parts = found.selectExpr("spark_partition_id() AS part", "year", "__key").collect()
    runs = [[(r.year, r["__key"]) for r in parts if r.part == part] for part in range(4)]
    assert all(run == sorted(run) for run in runs) and sum(runs, []) == sorted(sum(runs, []))
    assert sorted(map(str, found.select(labelled.columns).collect())) == sorted(map(str, labelled.collect()))
