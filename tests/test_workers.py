"""Python workers must not need the package on their path."""

import os
import subprocess
import sys
from pathlib import Path

from conftest import SMALL_DIR

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from navette.plans.queries import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("class_natural_breaks", "scan_zip_member"):
    print(name, QUERIES[name](spark, {data!r}).count())
"""


def test_run_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, data=SMALL_DIR)],
        cwd=tmp_path,
        env=environment,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "scan_zip_member 6000" in done.stdout
