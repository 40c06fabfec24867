"""Helpers of the text operators: byte kernels, written steps, summed blocks, components.

Byte kernels work on the UTF-8 bytes of a slice of documents at once. A span hash is
a polynomial hash of 64 bits over a random table of byte values; where equality must
be certain, bytes are compared or a second hash is carried.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navette.sources.shared import fresh_path

#: Bytes of text a kernel takes at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
#: The same for kernels that hold many 64-bit numbers for each byte.
SMALL_SLICE_BYTES = 512 << 10
#: Bytes of rows that a written step hands to Python at once, rather than 10,000 rows of any length.
BATCH_BYTES = 8 << 20

WORD_BYTES = "[^\\x20\\x09-\\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)


class _Kept(dict):
    """A cache of the process that never travels with a function."""

    def __reduce__(self):
        return _Kept, ()


_STEPS = _Kept()


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _steps(name: str, base: int, n: int) -> np.ndarray:
    have = _STEPS.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SMALL_SLICE_BYTES) + 65536, base, np.uint64)
        have[0] = 1
        have = _STEPS[name] = np.multiply.accumulate(have)
    return have[:n]


class ByteHash:
    """Hashes of any spans of a byte buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf] * _steps("up", _BASE, n), out=self.sums[1:])
        self.down = _steps("down", pow(_BASE, -1, 2**64), n + 1)

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the window that starts at each byte."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without gaps, and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text of one holds about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(start, stop - start)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of every word (bytes between ASCII spaces) of the rows."""
    inside = ~_SPACE[buf]
    filled = offsets[:-1] < offsets[1:]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][filled]] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, stop


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[buf]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside pass rows to Python in batches cut by bytes too; the session's setting comes back after."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back, so that lost executors cost no earlier step."""
    spark, schema = frame.sparkSession, frame.schema
    path = fresh_path(spark, name)
    with small_batches(spark):
        frame.write.parquet(path)
    del frame
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver collect garbage: only then does Spark delete shuffle files no plan needs any more."""
    for _ in range(2):  # what the first round finds unused lets go of more
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of ``left`` stay."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(right, on, how).drop(*(f"__right_{k}" for k in keys))


BLOCKS = 16


def as_blocks(table: np.ndarray) -> pa.RecordBatch:
    """A one-dimensional table as ``BLOCKS`` rows, for ``summed``."""
    parts = [part.tobytes() for part in np.array_split(table, BLOCKS)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "part"]
    )


def summed(frame: DataFrame, dtype: str) -> np.ndarray | None:
    """Element-wise sum of the tables that tasks emitted by ``as_blocks``; None without any.

    The tables have a fixed size, so the result does; blocks are added on the executors.
    """

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(part, dtype)
                total[block] = total[block] + values if block in total else values
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                ["block", "part"],
            )

    dealt = frame.select("block", "part").repartition(BLOCKS, "block")
    rows = dealt.mapInArrow(add, "block int, part binary").collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r.part, dtype) for r in sorted(rows, key=lambda r: r.block)])


def held_out(key, modulus: int, remainder: int):
    """Whether crc32 of a key as text leaves the remainder."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000, least_bytes: int = 1 << 62
) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the keys.

    Memory holds ``least`` rows or ``least_bytes`` bytes, one batch and one group; callers bound their groups.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    enough = least_bytes
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < least and size < enough:
            continue
        table = pa.Table.from_batches(held)
        last = _last_group_start(table, keys)
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
        rows, size = table.num_rows - last, sum(b.nbytes for b in held)
        # a group longer than the bounds is not looked at again until it has doubled
        least, enough = max(least, 2 * rows), max(least_bytes, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def _last_group_start(table: pa.Table, keys: list[str]) -> int:
    same = None
    for key in keys:
        column = table.column(key)
        part = pc.fill_null(pc.equal(column, column[-1]), False)
        if not column[-1].is_valid:
            part = pc.is_null(column)
        same = part if same is None else pc.and_(same, part)
    differs = np.flatnonzero(~same.to_numpy())
    return int(differs[-1]) + 1 if len(differs) else 0


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


#: Edges a task joins at once in ``forest``.
FOREST_EDGES = 1 << 18


def forest(edges: DataFrame) -> DataFrame:
    """Fewer (a, b) edges that connect the same nodes: each task keeps a spanning forest of what it reads."""

    def run(batches):
        up: dict[int, int] = {}
        kept: list[tuple[int, int]] = []

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up.setdefault(y, y)
                x = up[x]
            return x

        def told():
            a, b = zip(*kept, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one, two = root(a), root(b)
                if one != two:
                    up[two] = one
                    kept.append((a, b))
            if len(kept) >= FOREST_EDGES:
                yield told()
                up, kept = {}, []
        if kept:
            yield told()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is its smallest node.

    Alternates large-star and small-star steps on (a, b) edges until nothing moves.
    Each step is two aggregates with a map-side combine and a join, so a hub with
    many edges is split; steps are written to the shared folder.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = written(small.union(low.select("a", F.col("low").alias("b"))).distinct(), name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = nodes.select(F.col("component").alias("node"), "component").distinct()
    return nodes.union(roots)
