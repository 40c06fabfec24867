"""Operator 5: links between near-equal vectors of one label.

Vectors are normalised and hashed into several tables by quantised Gaussian projections (a
p-stable hash for Euclidean distance, which on unit vectors orders pairs as the cosine does). Rows of
a bucket are compared exactly, in double precision. With distance c and cell width w a
projection agrees with probability p(c); ``table_settings`` raises the number of projections with the number of
vectors, so that far pairs in a bucket stay few, and the number of tables with it, so
that a pair at the threshold is found with probability ``RECALL`` or more.

Equal vectors of a label are one class with a multiplicity. A pair of classes counts in the first table
that both share, so tasks emit counts for each class and edges of a spanning forest, never all pairs.
Buckets above ``BLOCK`` classes are cut into blocks, and each pair of blocks is a group of its own.

Null, empty and zero vectors, vectors with null or non-finite components and null labels link with nothing.
Vectors of unlike lengths do not link. Rows that repeat an id and vector are separate rows of a class. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navette.llm.common import components, mix, starts, whole_groups, written

COSINE = 0.93
WIDTH = 1.2
RECALL = 0.95
BLOCK = 1024


def agreement(distance: float, width: float = WIDTH) -> float:
    """Probability that a quantised Gaussian projection puts two points at this distance into one cell."""
    t = width / distance
    normal = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_settings(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections for each table, and tables, for n vectors."""
    near, far = agreement(math.sqrt(2 - 2 * cosine)), agreement(math.sqrt(2))
    projections = max(4, math.ceil(math.log(max(n, 2) / 50) / -math.log(far)))
    tables = math.ceil(math.log(1 - RECALL) / math.log1p(-(near**projections)))
    return projections, tables


def buckets(unit: np.ndarray, label: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """Bucket of each vector in each table; the label is part of it."""
    rng = np.random.default_rng([unit.shape[1], 5])
    lines = rng.normal(size=(unit.shape[1], tables * projections))
    shift = rng.uniform(0, WIDTH, tables * projections)
    cells = np.floor((unit @ lines + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    out = np.broadcast_to(mix(label.astype(np.int64).view(np.uint64) + np.uint64(unit.shape[1] << 40))[:, None], cells.shape[:2]).copy()
    for i in range(projections):
        out = mix(out * np.uint64(31) + cells[:, :, i])
    return mix(out + np.arange(tables, dtype=np.uint64))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float64) for x in column.to_pylist()]


def classes_of(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Usable rows as (vec_id, label, unit): the normalised vector as bytes."""
    rows = vectors.select(
        F.col(key).alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )

    def run(batches):
        for batch in batches:
            keep, units = [], []
            for i, value in enumerate(batch.column("vector")):
                if not value.is_valid or value.values.null_count or not len(value.values):
                    continue
                v = value.values.to_numpy()
                # a power of two as common factor keeps squares in range and changes no direction
                if not np.isfinite(v).all() or not v.any():
                    continue
                v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
                keep.append(i)
                units.append((v / np.linalg.norm(v) + 0.0).tobytes())
            at = pa.array(keep, pa.int64())
            columns = [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "unit"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.where("label is not null").mapInArrow(run, f"vec_id {kind}, label long, unit binary")


def _link_groups(table: pa.Table, cosine: float, projections: int, tables: int):
    """Counts and forest edges of whole (bucket, block pair) groups."""
    bucket, one, two, nth, which, node, times, label = (
        table.column(c).to_numpy() for c in ("bucket", "one", "two", "nth", "block", "node", "times", "label")
    )
    units = table.column("unit").to_pylist()
    counts: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    first = starts(bucket, one, two)
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
        if e - s < 2:
            continue
        by_length: dict[int, list[int]] = {}
        for i in range(s, e):
            by_length.setdefault(len(units[i]), []).append(i)
        for members in by_length.values():
            rows = np.array(members)
            unit = np.frombuffer(b"".join(units[i] for i in members), np.float64).reshape(len(rows), -1)
            keys = buckets(unit, label[rows], projections, tables)
            if one[s] == two[s]:
                left = right = np.arange(len(rows))
            else:
                left, right = np.flatnonzero(which[rows] == one[s]), np.flatnonzero(which[rows] == two[s])
            near = unit[left] @ unit[right].T >= cosine
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            if one[s] == two[s]:
                i, j = i[i < j], j[i < j]
            same = label[rows[i]] == label[rows[j]]
            i, j = i[same], j[same]
            earlier = np.zeros(len(i), bool)
            for t in range(int(nth[s])):
                earlier |= keys[i, t] == keys[j, t]
            i, j = i[~earlier], j[~earlier]
            for a, b in ((i, j), (j, i)):
                sums = np.bincount(a, times[rows[b]], minlength=len(rows))
                for k in np.flatnonzero(sums).tolist():
                    counts[int(node[rows[k]])] = counts.get(int(node[rows[k]]), 0) + int(sums[k])
            edges += _forest(node[rows], i, j)
    return counts, edges


def _forest(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep the connection of all of (i, j)."""
    up = np.arange(len(node))
    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b:
            up[b] = a
            out.append((int(node[a]), int(node[b])))
    return out


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    block: int = BLOCK,
    settings: tuple[int, int] | None = None,
) -> DataFrame:
    """Per vector: key, n_links, component_id (smallest linked key) and kept."""
    usable = written(classes_of(vectors, key, vector, label), "vectors-usable")
    classes = usable.groupBy("label", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    # a node is named by hash; a hash is 64 bits of label and vector
    classes = written(classes.withColumn("node", F.xxhash64("label", "unit")), "vectors-classes")
    projections, tables = settings or table_settings(classes.count(), cosine)

    def hashed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column("label").to_numpy()
            found = np.zeros((batch.num_rows, tables), np.uint64)
            by_length: dict[int, list[int]] = {}
            units = batch.column("unit").to_pylist()
            for i, u in enumerate(units):
                by_length.setdefault(len(u), []).append(i)
            for rows in by_length.values():
                unit = np.frombuffer(b"".join(units[i] for i in rows), np.float64).reshape(len(rows), -1)
                found[rows] = buckets(unit, labels[rows], projections, tables)
            n = batch.num_rows
            columns = [
                pa.array(found.ravel().view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
                pa.array(np.repeat(batch.column("node").to_numpy(), tables)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "nth", "node"])

    entries = written(classes.mapInArrow(hashed, "bucket long, nth int, node long"), "vectors-buckets")
    sizes = entries.groupBy("bucket", "nth").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select("bucket", "nth", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    placed = entries.join(sizes, ["bucket", "nth"]).withColumn("block", F.expr("int(pmod(xxhash64(node, 1), blocks))"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = placed.withColumn("other", F.explode(others)).withColumns(
        {"one": F.least("block", "other"), "two": F.greatest("block", "other")}
    )
    full = placed.join(classes.select("node", "times", "label", "unit"), "node")
    full = full.select("bucket", "one", "two", "nth", "block", "node", "times", "label", "unit")
    full = full.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "node")

    def links(batches):
        for table in whole_groups(batches, ["bucket", "one", "two"], least=4000):
            counts, edges = _link_groups(table.combine_chunks(), cosine, projections, tables)
            n, m = len(counts), len(edges)
            columns = [
                pa.array([*counts, *(a for a, _ in edges)], pa.int64()),
                pa.array([*([None] * n), *(b for _, b in edges)], pa.int64()),
                pa.array([*counts.values(), *([None] * m)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])

    found = written(full.mapInArrow(links, "a long, b long, links long"), "vectors-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("outer"))
    groups = components(found.where("b is not null").select("a", "b"), "vectors-components")
    named = classes.join(counts, "node", "left").join(groups, "node", "left")
    named = named.select(
        "label", "unit", "least", (F.coalesce("outer", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("group"),
    )
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    linked = usable.join(named.join(least, "group").select("label", "unit", "n_links", "component_id"), ["label", "unit"])
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select(F.col(key).alias("vec_id")).join(linked, "vec_id", "left")
    result = rows.select(
        F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return result.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
