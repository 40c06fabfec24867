import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from navette.operators.lookup import Lookup  # noqa: E402

SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("navette-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


REGISTRY_ROWS = [
    ("01004", "Ambérieu", "Plaine"),
    ("1004", "Autre", "Plaine"),
    ("A", "Alpha", "Nord"),
    ("B", "Beta", "Nord"),
    ("C", "Gamma", "Nord"),
    ("D", "Alpha", "Sud"),
]


@pytest.fixture(scope="session")
def registry(spark):
    return Lookup.of(spark.createDataFrame(REGISTRY_ROWS, "code STRING, name STRING, epci STRING"), "code")


@pytest.fixture(scope="session")
def make_flux(spark):
    from navette.operators.flows import as_flows, with_mode

    schema = "resid_code STRING, work_code STRING, weight DOUBLE, mode_code STRING, year INT"

    def make(rows):
        return as_flows(with_mode(spark.createDataFrame(rows, schema)))

    return make


def as_dict(frame, *keys):
    """Rows keyed by the given columns."""
    return {tuple(row[k] for k in keys): row for row in frame.collect()}
