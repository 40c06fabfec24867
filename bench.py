"""Headline queries on one data set; prints one JSON line.

Every query runs ``BENCH_RUNS`` times in a warm session and reports its median.
All columns of all rows are produced (no-op sink). The stored flow mart is built
before the clock of its readers starts; building it is timed as ``mart_write``.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from navette.plans.census import Census
from navette.plans.queries import QUERIES
from navette.sources.mart import write_mart
from navette.sources.shared import fresh_path

HEADLINE = [
    "flow_mart",
    "od_mode_share",
    "od_mode_share_from_mart",
    "od_mode_share_all",
    "od_mode_share_selected",
    "od_oneway_shares_all",
    "share_by_residence_mode",
    "share_by_residence_mode_all",
    "flux_labelled",
    "flux_epci_any",
    "weighted_by_residence",
    "membership_stats",
    "od_wide_totals",
    "commune_order",
    "choropleth_measures",
    "class_natural_breaks",
    "control_total_recon",
]


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("navette-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = statistics.median(seconds(lambda: run(name)) for _ in range(runs))
    census = Census(spark, sf_dir)
    times["mart_write"] = statistics.median(
        seconds(lambda: write_mart(census.mart(), fresh_path(spark, "bench-mart")))
        for _ in range(min(runs, 3))
    )
    times = {name: round(value, 3) for name, value in times.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
