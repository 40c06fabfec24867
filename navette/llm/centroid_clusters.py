"""Operator 11: clusters of integer vectors around centroids, exact in every step.

Vectors become integers once and are written to the shared folder. In each round the driver builds a
vantage-point tree over the centroids (``k`` of them, a parameter) and broadcasts it; tasks search
it for each vector and emit one table of component sums and counts (k x (components + 1)), which executors
add. So a cluster that holds most vectors costs a task no more than any other, and no vector is shuffled.

Kept are vectors with exactly ``components`` components, none of them null or non-finite; a vector with an integer component
beyond ``largest_component`` is not kept either, since its distances do not fit 64 bits. Repeated rows are vectors of
their own; the first centroids are the rows with the smallest digests, equal ones by their components, null keys
last. With fewer vectors than ``k`` there are as many centroids as vectors. Sums of distances beyond 64
bits are null. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navette.llm.centroid_tree import CentroidTree, largest_component
from navette.llm.common import as_blocks, summed, written

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
#: Vectors searched at once.
BLOCK = 4096


def integer_vectors(vectors: DataFrame, key: str, vector: str, components: int, scale: int) -> DataFrame:
    """Kept rows as (vec_id, cells): floor(scale * component) as 32-bit integers."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    most = largest_component(components)

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            whole = pc.fill_null(pc.equal(pc.list_value_length(column), components), False)
            kept = batch.filter(whole)
            if not kept.num_rows:
                continue
            flat = kept.column("vector").flatten().to_numpy(zero_copy_only=False)  # a null becomes NaN
            with np.errstate(over="ignore", invalid="ignore"):
                cells = np.floor(flat.reshape(-1, components) * scale)
                fits = (np.abs(cells) <= most).all(1)
            data = cells[fits].astype(np.int32)
            packed = pa.array([row.tobytes() for row in data], pa.binary())
            yield pa.RecordBatch.from_arrays([kept.column("vec_id").filter(pa.array(fits)), packed], ["vec_id", "cells"])

    return rows.mapInArrow(run, f"vec_id {rows.schema[0].dataType.simpleString()}, cells binary")


def _cells(column: pa.Array, components: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    return flat.reshape(-1, components).astype(np.int64)


def _blocks(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def first_centroids(cells: DataFrame, k: int, seed: str, components: int) -> np.ndarray:
    """The k rows with the smallest digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = cells.orderBy(digest.asc_nulls_last(), "cells").limit(k).collect()
    return np.array([np.frombuffer(r["cells"], np.int32) for r in rows], np.int64).reshape(-1, components)


def moved_centroids(cells: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of each centroid's vectors; a centroid without any stays."""
    shared = cells.sparkSession.sparkContext.broadcast(CentroidTree(centroids))
    k, dim = centroids.shape

    def sums(batches):
        table = np.zeros((k, dim + 1), np.int64)
        for batch in _blocks(batches):
            found = _cells(batch.column("cells"), dim)
            who, _ = shared.value.nearest(found)
            order = np.argsort(who, kind="stable")
            mine, first = np.unique(who[order], return_index=True)
            table[mine, :dim] += np.add.reduceat(found[order], first)
            table[:, dim] += np.bincount(who, minlength=k)
        if table[:, dim].any():
            yield as_blocks(table.ravel())

    total = summed(cells.mapInArrow(sums, "block int, part binary"), "int64").reshape(k, dim + 1)
    shared.destroy()
    count = total[:, dim:]
    return np.where(count > 0, total[:, :dim] // np.maximum(count, 1), centroids)


def assigned(cells: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    shared = cells.sparkSession.sparkContext.broadcast(CentroidTree(centroids))
    dim = centroids.shape[1]

    def search(batches):
        for batch in _blocks(batches):
            who, distance = shared.value.nearest(_cells(batch.column("cells"), dim))
            columns = [batch.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return cells.mapInArrow(search, f"vec_id {cells.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def centroid_clusters(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: str = "2:",
) -> tuple[DataFrame, np.ndarray]:
    """Per kept vector: key, cluster, distance, cluster_inertia and inertia; and the final centroids."""
    cells = written(integer_vectors(vectors, key, vector, components, scale), "clusters-cells")
    centroids = first_centroids(cells, k, seed, components)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved_centroids(cells, centroids)
    found = written(assigned(cells, centroids), "clusters-assigned")
    exact = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    own = exact.collect()  # one row for each centroid
    total = sum(row["own"] for row in own)
    fits = lambda x: int(x) if x < 1 << 63 else None
    sums = [(row["cluster"], fits(row["own"]), fits(total)) for row in own]
    stats = found.sparkSession.createDataFrame(sums, "cluster int, cluster_inertia long, inertia long")
    result = found.join(F.broadcast(stats), "cluster")
    return result.select(F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia"), centroids
