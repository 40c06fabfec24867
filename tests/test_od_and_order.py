import math
import random

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from navette.operators import flows, od, ranking, reconcile, shares
from navette.operators.lookup import Lookup


@pytest.fixture(scope="module")
def directions(make_flux):
    return make_flux(
        [
            ("A", "B", 2.0, "2", 2018),
            ("B", "A", 3.0, "3", 2018),
            ("A", "C", 4.0, "5", 2018),
            ("B", "B", 9.0, "1", 2018),
            ("C", "B", 0.0, "6", 2018),
            (None, "A", 7.0, "1", 2018),
        ]
    )


def test_undirected_merge(directions):
    wide = od.od_wide(directions, "year", "resid_code", "work_code")
    found = as_dict(od.with_shares(od.od_oneway(wide, "year")), "code_a", "code_b")
    assert set(found) == {("A", "B"), ("A", "C"), ("B", "C")}
    both = found[("A", "B")]
    assert (both["marche"], both["velo"], both["tc"], both["total"]) == (2.0, 3.0, 0.0, 5.0)
    assert both["share_active"] == 1.0
    assert found[("A", "C")]["share_active"] == 0.0
    assert found[("B", "C")]["share_active"] is None  # no flow at all


def test_direct_undirected_form_agrees(directions):
    wide = od.od_wide(directions, "year", "resid_code", "work_code")
    chosen = ["year", "code_a", "code_b", "total", "share_active", "share_sustainable"]
    two_steps = od.with_shares(od.od_oneway(wide, "year")).select(*chosen)
    direct = od.with_shares(od.od_oneway_from_flows(directions, "year")).select(*chosen)
    assert sorted(map(str, two_steps.collect())) == sorted(map(str, direct.collect()))


def test_pairs_compare_as_text(make_flux):
    frame = make_flux([("9", "10", 1.0, "1", 2018), ("10", "9", 1.0, "1", 2018)])
    row = od.od_oneway_from_flows(frame, "year").collect()
    assert [(r["code_a"], r["code_b"], r["total"]) for r in row] == [("10", "9", 2.0)]


def test_lines_need_both_centroids(spark, directions):
    centroids = Lookup.of(
        spark.createDataFrame([("A", -1.5, 47.25), ("B", -1.0, 47.0)], "code STRING, lon DOUBLE, lat DOUBLE"),
        "code",
    )
    wide = od.between_communes(od.od_wide(directions, "year", "resid_code", "work_code"))
    found = as_dict(od.desire_lines(wide, centroids, "resid_code", "work_code"), "resid_code", "work_code")
    assert set(found) == {("A", "B"), ("B", "A")}
    assert found[("A", "B")]["line"] == "LINESTRING (-1.500000 47.250000, -1.000000 47.000000)"


def test_equal_flows_are_ordered_by_name(make_flux, registry):
    frame = make_flux(
        [
            ("B", "A", 5.0, "1", 2018),
            ("A", "A", 5.0, "1", 2018),
            ("C", "A", 6.0, "1", 2018),
            (None, "A", 99.0, "1", 2018),
            ("Z", "A", 99.0, "1", 2018),
        ]
    )
    order = ranking.commune_order(flows.label_ends(frame, registry), "year")
    assert [(r["resid_name"], r["position"]) for r in order.orderBy("position").collect()] == [
        ("Gamma", 1),
        ("Alpha", 2),
        ("Beta", 3),
    ]


def test_commune_nobody_leaves_sorts_last(make_flux, registry):
    frame = make_flux([("A", "C", 1.0, "1", 2018), ("B", "A", 2.0, "1", 2018)])
    order = ranking.commune_order(flows.label_ends(frame, registry), "year")
    cells = flows.totals(frame, "year", "resid_code", "work_code", "mode")
    places = Lookup.of(ranking.order_lookup(order, "year"), "code")
    found = ranking.in_display_order(ranking.with_display_order(cells, places, "year"), "year").collect()
    assert [(r["resid_code"], r["resid_position"], r["work_position"]) for r in found] == [
        ("B", 1, 2),
        ("A", 2, None),
    ]


def test_top_origins_exclude_the_commune_itself(make_flux, registry):
    frame = make_flux(
        [("A", "A", 9.0, "1", 2018), ("B", "A", 3.0, "1", 2018), ("C", "A", 3.0, "1", 2018), ("D", "A", 1.0, "1", 2018)]
    )
    found = ranking.top_origins(frame, registry, "A", 2).collect()
    assert [r["resid_code"] for r in found] == ["B", "C"]


def test_planted_differences_are_found(spark):
    computed = spark.createDataFrame(
        [("A", "B", 10.0), ("B", "A", 4.0), ("C", "C", 1.0)], "resid_code STRING, work_code STRING, flow DOUBLE"
    )
    published = spark.createDataFrame(
        [("A", "B", 11.0), ("B", "A", 4.2), ("D", "A", 2.0)], "resid_code STRING, work_code STRING, published DOUBLE"
    )
    found = as_dict(reconcile.reconcile(computed, published), "resid_code", "work_code")
    assert {k: r["status"] for k, r in found.items()} == {
        ("A", "B"): "different",
        ("B", "A"): "equal",
        ("C", "C"): "not published",
        ("D", "A"): "not computed",
    }
    assert found[("A", "B")]["difference"] == -1.0


# --- properties on random frames ---------------------------------------------


def random_rows(seed, n=400):
    rng = random.Random(seed)
    codes = ["A", "B", "C", "D", "Z", None]
    hot = rng.choice(codes)  # one key holds about a third of the rows
    return [
        (
            hot if rng.random() < 1 / 3 else rng.choice(codes),
            rng.choice(codes),
            rng.choice([None, 0.0, 1.0, 2.5, 4.0]),
            rng.choice(["1", "2", "3", "5", "6", "9", None]),
            rng.choice([2016, 2017, 2018]),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_invariants(make_flux, registry, seed):
    rows = random_rows(seed)
    frame = make_flux(rows).cache()
    weight = sum(r[2] or 0.0 for r in rows)

    # The mart keeps every observation and every unit of flow.
    mart = flows.flow_mart(frame, registry).cache()
    kept = mart.agg(F.sum("n_obs"), F.sum("flow")).first()
    assert tuple(kept) == (len(rows), weight)

    # From the mart or from survey rows, results are the same.
    def text(source):
        found = shares.mode_shares(source, "year", "resid_code", "work_code")
        return sorted(map(str, found.collect()))

    assert text(mart) == text(frame)

    # Shares add up to one in every group that has a flow.
    found = shares.mode_shares(frame, "year", "resid_code").filter(F.col("total") > 0)
    for row in found.groupBy("year", "resid_code").agg(F.sum("share").alias("s")).collect():
        assert math.isclose(row["s"], 1.0)

    # Mode columns add up to the total; merging directions keeps the flow.
    wide = od.od_wide(frame, "year", "resid_code", "work_code").cache()
    for row in od.with_row_total(wide).collect():
        assert math.isclose(row["total"], row["total_of_modes"])
    before = od.between_communes(wide).agg(F.sum("total")).first()[0]
    after = od.od_oneway(wide, "year").agg(F.sum("total")).first()[0]
    assert before == after

    # A flow touches one group per end, once if both ends share it.
    labelled = flows.label_ends(frame, registry)
    group = {code: epci for code, _, epci in [tuple(r) for r in registry.frame.collect()]}
    expected = sum(len({group.get(r[0]), group.get(r[1])} - {None}) for r in rows)
    assert flows.by_touched_group(labelled).count() == expected

    # One group asked for alone equals its slice of the all-group result.
    def flat(source, *columns):
        return sorted(str(tuple(r[c] for c in columns)) for r in source.collect())

    every = flows.outsiders_of_group_to_null(flows.by_touched_group(labelled))
    columns = ["year", "resid_code", "mode", "flow", "total", "share"]
    one = flows.outsiders_to_null(flows.touching(frame, registry.where(F.col("epci") == "Nord")))
    from_mart = flows.outsiders_to_null(flows.touching_group(mart, "Nord"))
    slice_ = shares.mode_shares(every, "year", "epci", "resid_code").filter("epci = 'Nord'")
    alone = flat(shares.mode_shares(one, "year", "resid_code"), *columns)
    assert flat(slice_, *columns) == alone
    assert flat(shares.mode_shares(from_mart, "year", "resid_code"), *columns) == alone


def test_shares_of_2016_are_unknown(make_flux):
    frame = make_flux([("A", "B", 2.0, "3", 2016), ("A", "B", 2.0, "3", 2017)])
    merged = od.od_oneway_from_flows(frame, "year")
    found = as_dict(od.with_shares(merged), "year")
    assert found[2016,]["total"] == 2.0 and found[2016,]["share_active"] is None
    assert found[2017,]["share_active"] == 1.0
    assert as_dict(od.with_shares(merged, F.lit(True)), "year")[2016,]["share_active"] == 0.0
