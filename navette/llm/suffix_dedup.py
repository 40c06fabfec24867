"""Operator 3: bytes of documents that repeat a passage of an earlier document.

A byte goes when a 50-byte string that covers it also starts in a document with a
smaller key. Only equal suffixes through 50 bytes matter, so suffixes are ordered no
deeper, by most significant digits, and groups of one leave after each pass:

1.  First digit: of every 50-byte window, the ``GRAM``-byte string with the smallest
    hash is its anchor. Equal windows have equal anchors at equal places, so suffixes are
    grouped by their anchor; a window whose anchor is in one document cannot repeat.
2.  Second digit: the bytes around the anchor that any window with it can cover.
    Documents beyond the first of an equal group are settled: every window there
    repeats. Equal groups within one slice of text are settled before the shuffle,
    so a passage in a third of all documents costs one row for each slice.
3.  Anchors with different surroundings: the windows themselves are sorted by a radix
    sort of eight-byte digits (``repeated_windows``), and equal groups name the windows
    of an earlier document. Anchors with more than ``CROWD`` different surroundings are not
    gathered; their windows are grouped by a 128-bit hash, which Spark adds up and splits.

Null text is empty. Texts below 50 bytes lose nothing. Matches never cross documents.
Rows that share a key never cover one another, since none has the smaller key; they are told apart
by a hash of the text. A null key is not smaller than any and covers nothing, nor is it covered.
Other columns are not read. An empty table gives an empty result.
Anchors and surroundings compare by 64 bits each (128 together), sorted windows byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navette.llm.common import ByteHash, mix, slices, starts, utf8, whole_groups, written

WINDOW = 50
GRAM = 20
#: Surroundings of one anchor that are sorted within a task.
CROWD = 8192

_REACH = WINDOW - GRAM
OFFSETS = _REACH + 1


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, ByteHash]:
    """Row, place in the buffer, anchor hash and surroundings hash of every anchor of the rows."""
    hashes = ByteHash(buf)
    gram = hashes.windows(GRAM)
    none = np.zeros(0, np.int64)
    n_windows = len(buf) - WINDOW + 1
    if n_windows <= 0:
        return none, none, none.view(np.uint64), none.view(np.uint64), hashes
    least, width = gram, 1
    while 2 * width <= OFFSETS:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = OFFSETS - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    whole = np.zeros(len(buf) + 1, np.int8)
    lengths = np.diff(offsets)
    long = lengths >= WINDOW
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[1:][long] - WINDOW + 1, -1)
    inside = np.cumsum(whole[:n_windows], dtype=np.int8) > 0
    # a place is an anchor if it is the least of a window that lies in one document
    chosen = np.zeros(len(gram), bool)
    for i in range(OFFSETS):
        chosen[i : i + n_windows] |= (gram[i : i + n_windows] == least[:n_windows]) & inside
    at = np.flatnonzero(chosen)
    row = np.searchsorted(offsets, at, "right") - 1
    low, high = around(at, offsets[row], offsets[row + 1])
    context = mix(hashes.spans(low, high) + (at - low).astype(np.uint64))
    return row, at, gram[at], context, hashes


def around(at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that windows over an anchor can cover within its document."""
    return np.maximum(at - _REACH, begin), np.minimum(at + WINDOW, end)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """One row for each anchor; settled ones go by document instead of by anchor."""

    def run(batches):
        for batch in slices(batches):
            keyed = batch.filter(batch.column("doc_id").is_valid())
            if not keyed.num_rows:
                continue
            ids = keyed.column("doc_id").to_numpy()
            twins = keyed.column("twin").to_numpy()
            buf, offsets = utf8(keyed.column("text"))
            row, at, gram, context, _ = anchors(buf, offsets)
            doc = ids[row]
            order = np.lexsort((doc, context, gram))
            row, at, gram, context, doc = (x[order] for x in (row, at, gram, context, doc))
            first = starts(gram, context)
            least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
            settled = doc > least
            route = np.where(settled, doc.astype(np.uint64), gram).view(np.int64)
            columns = [route, context.view(np.int64), doc, (at - offsets[row]).astype(np.int32), twins[row], settled]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["route", "context", "doc_id", "at", "twin", "settled"]
            )

    return docs.mapInArrow(run, "route long, context long, doc_id long, at int, twin long, settled boolean")


def sorted_out(found: DataFrame) -> DataFrame:
    """Anchors that repeat an earlier document whole, or that need their windows compared (``settled`` false)."""
    anchor = Window.partitionBy("route", "settled")
    same = Window.partitionBy("route", "settled", "context")
    # both windows use one exchange: equal surroundings lie within an anchor
    seen = found.repartition("route").withColumns(
        {
            "least": F.min("doc_id").over(same),
            "one": F.min("doc_id").over(anchor),
            "other": F.max("doc_id").over(anchor),
            "here": F.min("context").over(anchor),
            "there": F.max("context").over(anchor),
        }
    )
    whole = F.col("settled") | (F.col("doc_id") > F.col("least"))
    open_ = (F.col("one") < F.col("other")) & (F.col("here") < F.col("there"))
    return seen.where(whole | open_).select("doc_id", "twin", "at", whole.alias("settled"), "route")


def contexts(texts: DataFrame) -> DataFrame:
    """The bytes around each open anchor: (route, doc_id, twin, at, before, around)."""

    def run(batches):
        for batch in slices(batches):
            buf, offsets = utf8(batch.column("text"))
            places = batch.column("open")
            row = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            flat = places.flatten()
            at = flat.field("at").to_numpy().astype(np.int64) + offsets[row]
            low, high = around(at, offsets[row], offsets[row + 1])
            data = buf.tobytes()
            cut = [data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            columns = [
                flat.field("route"),
                pa.array(batch.column("doc_id").to_numpy()[row]),
                pa.array(batch.column("twin").to_numpy()[row]),
                flat.field("at"),
                pa.array((at - low).astype(np.int32)),
                pa.array(cut, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["route", "doc_id", "twin", "at", "before", "around"])

    return texts.mapInArrow(run, "route long, doc_id long, twin long, at int, before int, around binary")


def repeated_windows(group: np.ndarray, doc: np.ndarray, before: np.ndarray, around: list[bytes]) -> np.ndarray:
    """Per context a bit for each window, counted back from the anchor, that an earlier document of the group has.

    Most-significant-digit radix sort of the windows: groups start as (anchor, offset) and
    are refined by eight bytes at a time; groups of one leave after each pass.
    """
    size = np.array([len(x) for x in around])
    padded = np.zeros((len(around), _REACH + WINDOW + 6), np.uint8)
    for i, (b, x) in enumerate(zip(before.tolist(), around, strict=True)):
        padded[i, _REACH - b : _REACH - b + len(x)] = np.frombuffer(x, np.uint8)
    context = np.repeat(np.arange(len(around)), OFFSETS)
    back = np.tile(np.arange(OFFSETS), len(around))
    fits = (back <= before[context]) & (before[context] - back + WINDOW <= size[context])
    context, back = context[fits], back[fits]
    _, named = np.unique(group, return_inverse=True)
    klass = named[context] * OFFSETS + back
    for depth in range(0, WINDOW, 8):
        width = min(8, WINDOW - depth)
        begin = _REACH - back + depth
        digit = np.zeros(len(context), np.uint64)
        for j in range(width):
            digit = (digit << np.uint64(8)) | padded[context, begin + j].astype(np.uint64)
        # any order that keeps equal (class, digit) pairs together will do; one key sorts faster than two
        order = np.argsort(mix(digit ^ mix(klass.astype(np.uint64))))
        context, back, klass, digit = (x[order] for x in (context, back, klass, digit))
        first = starts(klass, digit)
        length = np.diff(np.append(first, len(klass)))
        klass = np.repeat(np.arange(len(first)), length)
        several = np.repeat(length > 1, length)
        context, back, klass = context[several], back[several], klass[several]
    bits = np.zeros(len(around), np.int64)
    if len(klass):
        first = starts(klass)
        length = np.diff(np.append(first, len(klass)))
        least = np.repeat(np.minimum.reduceat(doc[context], first), length)
        later = doc[context] > least
        np.bitwise_or.at(bits, context[later], np.int64(1) << back[later])
    return bits


def window_hits(found: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, twin, at, bits) of open anchors with windows that an earlier document has."""
    crowded = found.groupBy("route").count().where(F.col("count") > crowd).select("route", F.lit(True).alias("crowded"))
    marked = found.join(crowded, "route", "left")
    few = marked.where("crowded is null").drop("crowded").repartition("route").sortWithinPartitions("route", "doc_id")

    def run(batches):
        for table in whole_groups(batches, ["route"]):
            bits = repeated_windows(
                table.column("route").to_numpy(),
                table.column("doc_id").to_numpy(),
                table.column("before").to_numpy(),
                table.column("around").to_pylist(),
            )
            out = table.select(["doc_id", "twin", "at"]).append_column("bits", pa.array(bits))
            yield from out.filter(pa.array(bits != 0)).combine_chunks().to_batches()

    def spread(batches):
        for batch in batches:
            rows = []
            for i, (b, x) in enumerate(zip(batch.column("before").to_pylist(), batch.column("around").to_pylist(), strict=True)):
                for back in range(min(b, _REACH) + 1):
                    if b - back + WINDOW <= len(x):
                        digest = hashlib.blake2b(x[b - back : b - back + WINDOW], digest_size=16).digest()
                        rows.append((i, back, digest))
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(c).take(at) for c in ("doc_id", "twin", "at")]
            columns += [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "twin", "at", "back", "digest"])

    many = marked.where("crowded").select("doc_id", "twin", "at", "before", "around")
    many = many.mapInArrow(spread, "doc_id long, twin long, at int, back int, digest binary")
    least = many.groupBy("digest").agg(F.min("doc_id").alias("least"))
    later = many.join(least, "digest").where("doc_id > least")
    later = later.select("doc_id", "twin", "at", F.expr("shiftleft(1L, back)").alias("bits"))
    return few.mapInArrow(run, "doc_id long, twin long, at int, bits long").union(later)


def removed_bytes(size: int, settled: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes of a document go: around settled anchors all, elsewhere the windows that are set."""
    edge = np.zeros(size + 1, np.int64)
    low, high = around(settled, np.zeros_like(settled), np.full_like(settled, size))
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    for back in range(OFFSETS):
        begin = at[(bits >> back) & 1 == 1] - back
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, kept (bytes that stay), n_bytes, n_removed and n_spans."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shared = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    docs = docs.withColumn("twin", F.xxhash64("text") if shared else F.lit(0).cast("long"))
    found = written(sorted_out(anchor_rows(docs)), "repeats-anchors")

    by_doc = ["doc_id", "twin"]
    whole = found.where("settled").groupBy(*by_doc).agg(F.collect_list("at").alias("settled"))
    open_ = found.where("not settled").groupBy(*by_doc).agg(F.collect_list(F.struct("at", "route")).alias("open"))
    hits = window_hits(written(contexts(docs.join(open_, by_doc)), "repeats-contexts"))
    parts = hits.groupBy(*by_doc).agg(F.collect_list(F.struct("at", "bits")).alias("hits"))
    marks = written(whole.join(parts, by_doc, "full_outer"), "repeats-marks")

    def run(batches):
        names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
        for batch in slices(batches):
            kept, sizes, gone, runs = [], [], [], []
            for i, value in enumerate(batch.column("text")):
                data = value.as_buffer()
                data = b"" if data is None else data.to_pybytes()
                settled, hit = batch.column("settled")[i], batch.column("hits")[i]
                sizes.append(len(data))
                if not settled.is_valid and not hit.is_valid:
                    kept.append(data), gone.append(0), runs.append(0)
                    continue
                none = np.zeros(0, np.int64)
                at = settled.values.to_numpy().astype(np.int64) if settled.is_valid else none
                hit_at = hit.values.field("at").to_numpy().astype(np.int64) if hit.is_valid else none
                bits = hit.values.field("bits").to_numpy() if hit.is_valid else none
                remove = removed_bytes(len(data), at, hit_at, bits)
                kept.append(np.frombuffer(data, np.uint8)[~remove].tobytes())
                gone.append(int(remove.sum()))
                runs.append(int(remove[:1].sum()) + int((remove[1:] & ~remove[:-1]).sum()))
            columns = [batch.column("doc_id"), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))], names)

    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
    result = docs.join(marks, by_doc, "left").select("doc_id", "text", "settled", "hits")
    return result.mapInArrow(run, schema).withColumnRenamed("doc_id", key)
