from itertools import combinations

import numpy as np
import pytest
from conftest import as_dict
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from navette.functions import legend_label, number_text, od_share_label, share_label
from navette.operators import classify


def squares(values, counts, classes):
    total = 0.0
    for c in set(classes):
        v = np.repeat(values[classes == c], counts[classes == c].astype(int))
        total += ((v - v.mean()) ** 2).sum()
    return total


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.integers(0, 1000), min_size=1, max_size=9, unique=True),
    st.integers(1, 5),
    st.data(),
)
def test_natural_breaks_are_optimal(values, k, data):
    values = np.array(sorted(values), float)
    n = len(values)
    counts = np.array([data.draw(st.integers(1, 4)) for _ in values], float)
    classes = classify.least_squares_classes(values, counts, k)
    assert classes[0] == 1 and classes[-1] == min(k, n)
    assert set(np.diff(classes)) <= {0, 1}
    best = min(
        squares(values, counts, 1 + np.searchsorted(cut, np.arange(n), side="right"))
        for cut in combinations(range(1, n), min(k, n) - 1)
    )
    assert squares(values, counts, classes) == pytest.approx(best, abs=1e-6)


def test_natural_breaks_of_many_values():
    values = np.sort(np.random.default_rng(0).normal(size=20000)) + np.repeat([0, 50], 10000)
    classes = classify.least_squares_classes(values, np.ones(20000), 2)
    assert (classes[:10000] == 1).all() and (classes[10000:] == 2).all()


def test_natural_breaks_per_group(spark):
    rows = [("g", "a", 1.0), ("g", "b", 1.0), ("g", "c", 9.0), ("g", "d", None), ("h", "e", 5.0), (None, "f", 2.0)]
    frame = spark.createDataFrame(rows, "epci STRING, code STRING, v DOUBLE")
    found = as_dict(classify.natural_breaks(frame, "v", 3, "epci"), "code")
    assert {k[0]: r["natural_class"] for k, r in found.items()} == {
        "a": 1,
        "b": 1,
        "c": 2,
        "d": None,
        "e": 1,
        "f": 1,
    }


def test_class_limits(spark):
    values = [99.0, 100.0, 7499.0, 7500.0, 200000.0, 200001.0, None]
    frame = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    found = [r[0] for r in frame.select(classify.fixed_class(F.col("v"), classify.FLOW_BREAKS)).collect()]
    assert found == [None, 1, 1, 2, 7, None, None]


def test_shares_above_half_fall_outside_the_half_scale(spark):
    frame = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (0.51,), (1.0,)], "v DOUBLE")
    half = classify.fixed_class(F.col("v"), classify.HALF_SHARE_BREAKS)
    full = classify.fixed_class(F.col("v"), classify.SHARE_BREAKS)
    assert [tuple(r) for r in frame.select(half, full).collect()] == [(1, 1), (4, 4), (5, 6), (None, 6), (None, 10)]


def test_continuous_scale_of_equal_values_is_null(spark):
    rows = [("g", 2.0), ("g", 2.0), ("h", 1.0), ("h", 3.0), ("h", 2.0), (None, 4.0), (None, 8.0), (None, None)]
    found = classify.continuous_scale(spark.createDataFrame(rows, "k STRING, v DOUBLE"), "v", "k").collect()
    assert sorted((r["scale"] for r in found if r["k"] is None), key=str) == [0.0, 1.0, None]
    assert sorted((r["k"], r["v"], r["scale"]) for r in found if r["k"] == "h") == [("h", 1.0, 0.0), ("h", 2.0, 0.5), ("h", 3.0, 1.0)]
    assert [r["scale"] for r in found if r["k"] == "g"] == [None, None]


def test_ranks_are_shared(spark):
    frame = spark.createDataFrame([("g", 2.0), ("g", 2.0), ("g", 3.0), ("g", None)], "k STRING, v DOUBLE")
    found = classify.rank_scale(frame, "v", "k").orderBy(F.col("rank").asc_nulls_last()).collect()
    assert [r["rank"] for r in found] == [1, 1, 3, None]


def test_commune_without_jobs_has_no_measure_there(make_flux, registry):
    frame = make_flux([("A", "B", 2.0, "1", 2018), ("A", "B", 1.0, "1", 2018), ("Z", "B", 4.0, "1", 2018)])
    found = as_dict(classify.choropleth_measures(frame, registry, [2018]), "code")
    assert (found[("A",)]["domicile"], found[("A",)]["travail"]) == (3.0, None)
    assert (found[("B",)]["domicile"], found[("B",)]["travail"]) == (None, 7.0)
    assert (found[("C",)]["year"], found[("C",)]["domicile"]) == (2018, None) and ("Z",) not in found


def test_every_commune_has_a_row_each_year(make_flux, registry):
    frame = make_flux([("A", "B", 2.0, "1", 2017), ("C", "C", 1.0, "1", 2017), ("A", "B", 1.0, "1", 2018)])
    found = as_dict(classify.choropleth_measures(frame, registry, [2017, 2018]), "code", "year")
    assert len(found) == 2 * registry.rows
    assert (found["C", 2017]["domicile"], found["C", 2018]["domicile"]) == (1.0, None)
    assert found["A", 2018]["domicile"] == 1.0 and found["D", 2017]["travail"] is None


def test_without_years_communes_stay(make_flux, registry):
    found = classify.choropleth_measures(make_flux([]), registry, []).collect()
    assert len(found) == registry.rows and {r["year"] for r in found} == {None}


def test_fractional_measures_in_any_order_have_a_class(spark):
    rng = np.random.default_rng(3)
    rows = [("g", f"c{i % 40}", float(w)) for i, w in enumerate(rng.random(4000))]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(g, c, float(w)) for g, c, w in rows], "epci STRING, code STRING, w DOUBLE")
    summed = frame.repartition(7).groupBy("epci", "code").agg(F.sum("w").alias("v"))
    classed = classify.natural_breaks(summed, "v", 3, "epci").collect()
    assert len(classed) == 40 and {r["natural_class"] for r in classed} == {1, 2, 3}
    by_value = [r["natural_class"] for r in sorted(classed, key=lambda r: r["v"])]
    assert by_value == sorted(by_value)
    scaled = [r["scale"] for r in classify.continuous_scale(summed, "v", "epci").collect()]
    assert len(scaled) == 40 and all(0.0 <= x <= 1.0 for x in scaled)


def test_label_texts(spark):
    frame = spark.createDataFrame(
        [("Vélo", 12.5, 50.0), (None, 3.4, 12345678.0), ("TC", 0.0, 0.0)], "mode STRING, n DOUBLE, t DOUBLE"
    ).withColumn("share", F.col("n") / F.nullif(F.col("t"), F.lit(0.0)))
    n, t, s = F.col("n"), F.col("t"), F.col("share")
    found = frame.select(share_label(n, t, s), od_share_label(F.col("mode"), n, t, s)).collect()
    assert found[0][0] == "Part modale : 25 % \nTrajets : 13 / 50"
    assert found[0][1] == "Vélo \nPart modale : 25 %\nTrajets : 13 / 50"
    assert found[1][1] == "NA \nPart modale : 0 %\nTrajets : 3 / 12345678"
    assert found[2][0] == "Part modale : NA % \nTrajets : 0 / 0"


def test_number_text_keeps_a_real_decimal(spark):
    frame = spark.createDataFrame([(10.04,), (10.06,), (100.0,)], "v DOUBLE")
    assert [r[0] for r in frame.select(number_text(F.col("v"), 1)).collect()] == ["10", "10.1", "100"]


def test_legend(spark):
    frame = spark.createDataFrame([(0.125,), (0.135,), (1.0,), (0.0,), (1.5,), (7500.0,), (None,)], "v DOUBLE")
    assert [r[0] for r in frame.select(legend_label(F.col("v"))).collect()] == [
        "12 %",
        "14 %",
        "100 %",
        "0 %",
        "1.5",
        "7500",
        None,
    ]
