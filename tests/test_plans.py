"""What the physical plans must and must not contain."""

import re

import pytest
from conftest import SMALL_DIR
from pyspark.sql import functions as F

from navette.operators import flows, shares
from navette.plans.census import Census
from navette.plans.queries import QUERIES


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def census(spark):
    return Census(spark, SMALL_DIR)


def test_no_query_multiplies_rows_by_rows(spark):
    for name, build in QUERIES.items():
        plan = plan_of(build(spark, SMALL_DIR))
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_either_end_selection_does_not_shuffle_for_the_registry(census):
    members = census.members("EUROPE")
    plan = plan_of(flows.touching(census.flows(), members))
    before = plan_of(census.flows())
    assert plan.count("Exchange hashpartitioning") == before.count("Exchange hashpartitioning")


def test_share_needs_no_join(census):
    stored = census.stored_mart()
    plan = plan_of(shares.share_of_total(stored, "year", "resid_code", "work_code"))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_aggregates_combine_before_the_shuffle(census):
    plan = plan_of(flows.totals(census.flows(), "year", "resid_code"))
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning(year")


def test_wide_table_has_one_shuffle(spark, census):
    from navette.operators import od

    plan = plan_of(od.od_wide(census.stored_mart(), "year", "resid_code", "work_code"))
    assert plan.count("Exchange") == 1


def test_mart_scan_is_pruned(spark):
    plan = plan_of(QUERIES["mart_pruned_scan"](spark, SMALL_DIR))
    partition = re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "year" in partition and "1997" in partition
    assert "EqualTo(resid_epci,EUROPE)" in pushed and "EqualTo(work_epci,EUROPE)" in pushed


def test_mart_selection_of_one_group_reaches_the_scan(census):
    plan = plan_of(flows.touching_group(census.stored_mart(), "EUROPE"))
    assert "Or(EqualTo(resid_epci,EUROPE),EqualTo(work_epci,EUROPE))" in plan


def test_year_of_a_request_reaches_the_scan(census):
    plan = plan_of(census.flux(1997))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in plan


def test_scan_reads_only_what_is_used(census):
    plan = plan_of(flows.totals(census.flows(), "year"))
    read = re.search(r"FileScan parquet \[(l_orderkey.*?)\]", plan).group(1)
    assert "l_quantity" in read and "l_linenumber" not in read


def test_facts_are_never_broadcast(census):
    plan = plan_of(census.flux())
    assert "SortMergeJoin [l_orderkey" in plan


@pytest.mark.parametrize("name", ["class_continuous", "class_natural_breaks"])
def test_classes_do_not_sum_again(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL_DIR))
    assert "sum(" not in plan and "FileScan parquet [year" in plan


# Queries whose result is survey rows, the mart itself, codes the mart does not hold, or the named check.
READ_SURVEY = {
    "flow_mart", "od_mode_share", "od_oneway_shares_2016", "recode_modes", "scan_mode_labels",
    "flux_labelled", "flux_residents", "flux_workers", "flux_epci_any", "flux_epci_any_all", "flux_epci_intra",
}


def test_only_named_queries_read_survey_rows(spark):
    found = {name for name, build in QUERIES.items() if "l_orderkey" in plan_of(build(spark, SMALL_DIR))}
    assert found == READ_SURVEY


def test_hot_commune_is_split_when_the_registry_cannot_be_broadcast(spark, tmp_path, monkeypatch):
    """A key with most of the rows is read by several tasks of the join."""
    from navette.operators import lookup
    from navette.operators.lookup import Lookup

    rows = spark.range(400_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("resid_code"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    rows.write.parquet(str(tmp_path / "facts"))
    keys = spark.range(400_000).select(F.col("id").cast("string").alias("code"))
    keys = keys.unionByName(spark.createDataFrame([("hot",)], "code STRING"))
    keys.withColumn("name", F.col("code")).write.parquet(str(tmp_path / "registry"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "400KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 1)
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        registry = Lookup.of(spark.read.parquet(str(tmp_path / "registry")), "code")
        named = registry.attach(
            spark.read.parquet(str(tmp_path / "facts")), "resid_code", {"name": "resid_name"}
        )
        found = named.agg(F.count("resid_name"), F.count_if(F.col("resid_name") == "hot"), F.max("payload"))
        row = found.collect()[0]
        assert row[0] == 400_000 and row[1] == 266_667
        assert "skew=true" in plan_of(found)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_shares_of_every_group_need_no_shuffle(spark):
    plan = plan_of(QUERIES["share_by_residence_mode_all"](spark, SMALL_DIR))
    assert "Exchange" not in plan and "Generate" not in plan and "explode" not in plan
    assert "Exchange" not in plan_of(QUERIES["group_directions"](spark, SMALL_DIR))


def test_one_group_lies_in_one_bucket(census):
    files = census.touched_mart().select("epci", F.input_file_name().alias("file")).distinct().collect()
    assert len(files) == len({row["epci"] for row in files}) > 1


def test_display_order_attaches_stored_ranks(spark):
    plan = plan_of(QUERIES["od_display_order"](spark, SMALL_DIR))
    assert plan.count("Exchange") <= 3 and "Sort" not in plan and "Window" not in plan
