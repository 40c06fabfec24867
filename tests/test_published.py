import os
import time
from pathlib import Path

import pytest

from navette.plans import ingest
from navette.sources import published

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("id", T.LongType())])


def writer(spark, start, rows=10, seen=None):
    def write(folder):
        if seen is not None:
            seen.append(start)
        spark.range(start, start + rows).write.parquet(folder)

    return write


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def test_of_two_writers_the_one_that_started_first_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    inner = []

    def slow(folder):
        spark.range(0, 10).write.parquet(folder)
        # a second writer starts later and ends before the first one
        inner.append(published.publish_if_absent(spark, path, SCHEMA, writer(spark, 100)))

    outer = published.publish_if_absent(spark, path, SCHEMA, slow)
    assert ids(outer) == list(range(10))
    assert ids(inner[0]) == list(range(100, 110))  # still readable
    assert ids(published.publish_if_absent(spark, path, SCHEMA, writer(spark, 7))) == list(range(10))


def test_changed_input_is_noticed(spark, tmp_path):
    source, path, seen = tmp_path / "in.csv", str(tmp_path / "t"), []
    source.write_text("1\n")
    given = (spark, path, SCHEMA)
    published.publish_if_absent(*given, writer(spark, 0, seen=seen), inputs=[str(source)])
    published.publish_if_absent(*given, writer(spark, 1, seen=seen), inputs=[str(source)])
    assert seen == [0]
    source.write_text("1\n2\n")
    found = published.publish_if_absent(*given, writer(spark, 2, seen=seen), inputs=[str(source)])
    assert seen == [0, 2] and ids(found)[0] == 2
    assert published.rows_published(spark, path) == 10


def test_input_that_changes_during_the_write_leaves_no_receipt(spark, tmp_path):
    source, path = tmp_path / "in.csv", str(tmp_path / "t")
    source.write_text("1\n")

    def write(folder):
        spark.range(3).write.parquet(folder)
        source.write_text("1\n2\n3\n")

    with pytest.raises(published.InputsChanged):
        published.publish_if_absent(spark, path, SCHEMA, write, inputs=[str(source)])
    assert published.rows_published(spark, path) is None


def test_lost_files_are_named_and_unused_attempts_removed_after_their_age(spark, tmp_path):
    path = str(tmp_path / "t")
    first = published.publish_if_absent(spark, path, SCHEMA, writer(spark, 0))
    assert published.lost_files(spark, path).count() == 0
    gone = next(Path(path).rglob("*.parquet"))
    gone.unlink()
    assert [r["path"].endswith(gone.name) for r in published.lost_files(spark, path).collect()] == [True]
    again = published.publish_if_absent(spark, path, SCHEMA, writer(spark, 50))
    spark.range(1).write.parquet(f"{path}/interrupted")
    assert published.remove_unused(spark, path) == []
    for folder in Path(path).iterdir():
        os.utime(folder, (time.time() - 7200,) * 2)
    removed = published.remove_unused(spark, path, older_than=3600)
    assert len(removed) == 2 and "interrupted" in removed
    assert ids(again) == list(range(50, 60)) and first.schema == again.schema
    assert ids(published.publish_if_absent(spark, path, SCHEMA, writer(spark, 9))) == list(range(50, 60))


def test_empty_table_and_no_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert published.rows_published(spark, path) is None and published.lost_files(spark, path).count() == 0
    assert published.remove_unused(spark, path) == []
    published.publish_if_absent(spark, path, SCHEMA, writer(spark, 0, rows=0))
    assert published.rows_published(spark, path) == 0


def test_replaced_year_is_built_again_alone(spark, tmp_path):
    for year in (2017, 2018):
        (tmp_path / f"f_{year}.csv").write_text("COMMUNE;DCLT;IPONDI;TRANS\nA;B;1.5;2\n")
    sheet = tmp_path / "communes.csv"
    sheet.write_text("x\nCODGEO;LIBGEO;LIBEPCI\nA;Alpha;Nord\nB;Beta;Nord\n")
    given = (spark, str(tmp_path / "f_{year}.csv"), [2017, 2018], str(sheet), str(tmp_path / "mart"))
    assert {r["year"]: r["flow"] for r in ingest.build(*given).collect()} == {2017: 1.5, 2018: 1.5}
    folders = set(os.listdir(tmp_path / "mart"))
    (tmp_path / "f_2018.csv").write_text("COMMUNE;DCLT;IPONDI;TRANS\nA;B;1.5;2\nA;B;4;2\n")
    assert {r["year"]: r["flow"] for r in ingest.build(*given).collect()} == {2017: 1.5, 2018: 5.5}
    assert len(set(os.listdir(tmp_path / "mart")) - folders) == 1
