"""Map measures and the classes they fall into."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navette.functions.nulls import ratio, wsum
from navette.operators.lookup import Lookup

# Class limits of the flow map and of the two share maps.
FLOW_BREAKS = [100.0, 7500.0, 15000.0, 30000.0, 60000.0, 120000.0, 180000.0, 200000.0]
HALF_SHARE_BREAKS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]
SHARE_BREAKS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def choropleth_measures(
    flows: DataFrame, layer: Lookup, years: Sequence[int | None]
) -> DataFrame:
    """Flow by home and by work commune and year, on the geometry layer.

    Each flow is stacked under both of its communes, so one scan and one shuffle
    give both measures. Every commune of the layer has a row for each of ``years``;
    without rows for a role it has NULL there. Without years it has one row.
    """
    roles = F.array(
        F.struct(F.col("resid_code").alias("code"), F.lit(True).alias("home")),
        F.struct(F.col("work_code").alias("code"), F.lit(False).alias("home")),
    )
    stacked = flows.select("year", "flow", F.inline(roles))
    measures = stacked.groupBy("year", "code").agg(
        _if_any(F.col("home"), "flow").alias("domicile"),
        _if_any(~F.col("home"), "flow").alias("travail"),
    )
    each_year = F.array(*[F.lit(y) for y in years]).cast("array<int>")
    shown = layer.frame.withColumn("year", F.explode_outer(each_year))
    measures = measures.withColumnsRenamed({"year": "__year", "code": "__code"})
    same = [F.col(layer.key) == F.col("__code"), F.col("year").eqNullSafe(F.col("__year"))]
    return shown.join(measures, same, "left").drop("__year", "__code")


def _if_any(test: Column, measure: str) -> Column:
    return F.when(F.count_if(test) > 0, wsum(F.when(test, F.col(measure))))


def fixed_class(value: Column, breaks: Sequence[float]) -> Column:
    """Number of the interval (from 1) that holds the value, NULL outside.

    Intervals include their lower limit; the last includes its upper one as well.
    """
    last = len(breaks) - 1
    found = F.when(value == breaks[last], last)
    for i in range(last):
        found = found.when((value >= breaks[i]) & (value < breaks[i + 1]), i + 1)
    return found


def continuous_scale(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Position, from 0 to 1, of each value between the least and the greatest of its group.

    The limits are aggregated and joined back, so no task needs a whole group.
    Give a stored measure: a sum worked out twice can differ in its last digit.
    """
    limits = values.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    place = ratio(F.col(value) - F.col("__low"), F.col("__high") - F.col("__low"))
    inside = F.when(place < 0, 0.0).when(place > 1, 1.0).otherwise(place)
    return (
        _join_groups(values, limits, by).withColumn("scale", inside).drop("__low", "__high")
    )


def _join_groups(values: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which NULL keys match."""
    hidden = {key: f"__key_{key}" for key in keys}
    groups = groups.withColumnsRenamed(hidden)
    same = [F.col(key).eqNullSafe(F.col(hidden[key])) for key in keys]
    return values.join(groups, reduce(and_, same), "left").drop(*hidden.values())


def rank_scale(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Rank of each value within its group of communes, equal values sharing one."""
    order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    return values.withColumn("rank", F.when(F.col(value).isNotNull(), F.rank().over(order)))


def natural_breaks(values: DataFrame, value: str, k: int, *by: str) -> DataFrame:
    """Class (from 1) of each value under the least-squares partition into ``k``.

    Equal values are counted before grouping, so a task receives the distinct
    commune totals of one group, and all groups are solved in parallel. Each group
    gets the least value of each class, and values are compared with these limits.
    """
    known = values.filter(F.col(value).isNotNull())
    distinct = known.groupBy(*by, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    keys = list(by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__value")
        found = pdf["__value"].to_numpy(float)
        classes = least_squares_classes(found, pdf["__n"].to_numpy(float), k)
        starts = np.flatnonzero(np.diff(classes, prepend=0))
        return pdf[keys].head(1).assign(__limits=[found[starts].tolist()])

    key_types = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.select(*by).schema
    )
    limits = distinct.groupBy(*by).applyInPandas(solve, f"{key_types}, `__limits` array<double>")
    reached = F.size(F.filter("__limits", lambda low: low <= F.col(value)))
    classed = F.when(F.col(value).isNotNull(), F.greatest(reached, F.lit(1)))
    return _join_groups(values, limits, by).withColumn("natural_class", classed).drop("__limits")


def least_squares_classes(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Classes 1..k of sorted distinct values; on ties the upper classes are larger.

    Dynamic programme over prefixes. The best start of the last class does not
    decrease with the prefix, which halves the search range at every level.
    """
    n = len(values)
    k = min(k, n)
    centred = values - np.average(values, weights=counts)
    weight = np.concatenate(([0.0], np.cumsum(counts)))
    first = np.concatenate(([0.0], np.cumsum(counts * centred)))
    second = np.concatenate(([0.0], np.cumsum(counts * centred**2)))

    def spread(starts: np.ndarray, stop: int) -> np.ndarray:
        mass = weight[stop] - weight[starts]
        mean_part = (first[stop] - first[starts]) ** 2 / mass
        return second[stop] - second[starts] - mean_part

    cost = np.concatenate(([0.0], second[1:] - first[1:] ** 2 / weight[1:]))
    starts_by_class = []
    for c in range(2, k + 1):
        best = np.full(n + 1, np.inf)
        start = np.zeros(n + 1, dtype=int)
        pending = [(c, n, c - 1, n - 1)]
        while pending:
            low, high, from_start, to_start = pending.pop()
            if low > high:
                continue
            stop = (low + high) // 2
            candidates = np.arange(from_start, min(to_start, stop - 1) + 1)
            sums = cost[candidates] + spread(candidates, stop)
            pick = int(np.argmin(sums))
            best[stop], start[stop] = sums[pick], candidates[pick]
            pending.append((low, stop - 1, from_start, candidates[pick]))
            pending.append((stop + 1, high, candidates[pick], to_start))
        cost = best
        starts_by_class.append(start)

    classes = np.empty(n, dtype=int)
    stop = n
    for c in range(k, 1, -1):
        begin = starts_by_class[c - 2][stop]
        classes[begin:stop] = c
        stop = begin
    classes[:stop] = 1
    return classes
