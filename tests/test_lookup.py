import pytest
from pyspark.sql import functions as F

from navette.operators import flows, lookup
from navette.operators.lookup import Lookup, LookupKeyError


def test_repeated_code_is_refused(spark):
    twice = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z")], "code STRING, name STRING")
    with pytest.raises(LookupKeyError, match="for example A"):
        Lookup.of(twice, "code")


def test_missing_code_is_refused(spark):
    frame = spark.createDataFrame([("A", "x"), (None, "y")], "code STRING, name STRING")
    with pytest.raises(LookupKeyError, match="NULL"):
        Lookup.of(frame, "code")


def test_measured_size(registry):
    assert registry.rows == 6
    assert registry.size_bytes > 6 * 3 * lookup.VALUE_OVERHEAD
    assert registry.broadcastable
    assert registry.where(F.col("epci") == "Nord").broadcastable


def test_same_name_in_two_groups_is_joined_by_code(make_flux, registry):
    row = flows.label_ends(make_flux([("A", "D", 1.0, "1", 2018)]), registry).first()
    assert row["resid_name"] == row["work_name"] == "Alpha"
    assert (row["resid_epci"], row["work_epci"]) == ("Nord", "Sud")


def test_result_is_the_same_beyond_the_broadcast_bound(spark, make_flux, registry, monkeypatch):
    frame = make_flux([("A", "B", 1.0, "1", 2018), ("Z", None, 2.0, "2", 2018)])
    small = flows.label_ends(frame, registry)
    expected = sorted(map(str, small.collect()))
    assert "BroadcastHashJoin" in plan_of(small)
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = flows.label_ends(frame, registry)
        assert "BroadcastHashJoin" not in plan_of(large)
        assert sorted(map(str, large.collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_keep_members_on_either_end(make_flux, registry):
    frame = make_flux([("A", "D", 1.0, "1", 2018), ("D", "A", 1.0, "1", 2018), (None, "A", 1.0, "1", 2018)])
    members = registry.where(F.col("epci") == "Nord")
    assert flows.residents_of(frame, members).count() == 1
    assert flows.workers_in(frame, members).count() == 2


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()
