"""Operator 13: alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A sees a space and the text, tokenizer B the text (and puts the space before it itself). Both
sequences of token ends are sorted, and their merge is cut along diagonals: a binary search finds how many
ends of A and of B the first d of the merge hold, so each piece merges the same number of ends, whatever the lengths of
texts. A distinct end closes one stretch of bytes that lies in one token of A and one of B, which is a
link; an end of both closes a group. A tie that a diagonal separates is stitched: the later piece
emits the group and no second link.

1.  ``encoded``: one pass over the texts. Each row keeps its counts, the digest (or text) of its groups, and
    its distinct id pairs with how often they are linked. Written to the shared folder.
2.  ``pair_counts``: in how many documents a pair is linked, combined in each task before the shuffle.
3.  ``judged``: the most frequent pairs, ``TABLE_PAIRS`` at most, go to all executors, as does the highest count
    of each id of A (one for each entry of the vocabulary); pairs outside the table are joined by a shuffle.

Texts that are null, empty, or whose joined token bytes of A or B differ from space and text have no tokens: zeros and ''.
Rows may repeat and keys may be null: each row is a document of its own. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navette.llm.common import SLICE_BYTES, slices, utf8, written
from navette.llm.encoding import SLICE_BYTES as CHUNK_BYTES
from navette.llm.encoding import Chunks, Coded, Encoder, Vocabulary, chunks_of, coded, row_totals, spaced

#: Ends that a piece of the merge holds.
WORK = 1 << 16
#: Pairs that may be sent to all executors: 16 bytes each.
TABLE_PAIRS = 1 << 20
#: Distinct pairs a task counts before it passes them on.
HELD_PAIRS = 1 << 20


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a and of b the merge holds at each multiple of ``work`` and at its end; a goes first on ties."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # where the search has ended, any valid index will do
        more = a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - 1 - mid, 0, len(b) - 1)]
        low, high = np.where(open_ & more, mid + 1, low), np.where(open_ & ~more, mid, high)
    return low, d - low


def merged_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """Links and groups' ends of one piece: index pairs (token of a, token of b), each in order."""
    ends_a, ends_b = a[i0:i1], b[j0:j1]
    token_b = j0 + np.searchsorted(ends_b, ends_a)
    token_a = i0 + np.searchsorted(ends_a, ends_b)
    shared = np.zeros(len(ends_b), bool)
    inside = token_a < i1
    shared[inside] = a[token_a[inside]] == ends_b[inside]
    if i0 and len(ends_b) and a[i0 - 1] == ends_b[0]:  # the tie lies on the cut
        token_a[0], shared[0] = i0 - 1, True
    j = np.arange(j0, j1)
    links = np.concatenate([np.arange(i0, i1), token_a[~shared]]), np.concatenate([token_b, j[~shared]])
    return links, (token_a[shared], j[shared])


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK):
    """All links (pairs of token indexes) and the last tokens of all groups, from independent pieces."""
    i, j = diagonals(a, b, work)
    none = np.zeros(0, np.int64)
    links, groups = [(none, none)], [(none, none)]
    for n in range(len(i) - 1):
        link, group = merged_piece(a, b, i[n], i[n + 1], j[n], j[n + 1])
        links.append(link)
        groups.append(group)
    return tuple(tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for parts in (links, groups))


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, left-aligned, with room for a sign after them, and their lengths."""
    texts = [str(i).encode() for i in range(n)]
    width = len(texts[-1]) + 1
    table = np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(n, width)
    return table, np.fromiter(map(len, texts), np.int64, n)


def group_texts(ids_a, ids_b, group_ends, rows, digits) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2`` of all rows, one after the other, and the offsets of the rows.

    ``rows``: of each group, its row, in order.
    """
    table, size = digits
    last_a, last_b = group_ends
    n, m = len(ids_a), len(ids_b)
    ids, sign = np.empty(n + m, np.int64), np.full(n + m, ord(","), np.uint8)
    counts = np.diff(np.append(-1, last_a)), np.diff(np.append(-1, last_b))
    group_a, group_b = (np.repeat(np.arange(len(c)), c) for c in counts)
    before_a, before_b = last_a + 1, np.append(0, last_b[:-1] + 1)
    at_a, at_b = np.arange(n) + before_b[group_a], np.arange(m) + before_a[group_b]
    ids[at_a], ids[at_b] = ids_a, ids_b
    sign[at_a[last_a]], sign[at_b[last_b]] = ord("|"), ord(";")
    width = size[ids]
    cells = table[ids]
    cells[np.arange(n + m), width] = sign
    flat = cells[np.arange(table.shape[1]) <= width[:, None]]
    stops = np.cumsum(width + 1)[at_b[last_b]]
    final = np.append(rows[1:] != rows[:-1], True)
    return flat, np.append(0, stops[final])


class Aligner:
    """Both tokenizers in a task."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.sides = [Encoder(a, plain=True), Encoder(b, plain=True)]
        self.names = [side.token_bytes() for side in self.sides]
        self.sizes = [np.fromiter(map(len, names), np.int64, len(names)) for names in self.names]
        self.digits = _decimals(max(map(len, self.names)))

    def _whole(self, side: int, chunks: Chunks, found: Coded, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose joined token bytes are the row's own."""
        names, size = self.names[side], self.sizes[side]
        own, cuts = utf8(chunks.distinct)
        if self.sides[side].adds_space:
            own, cuts = spaced(own, cuts)
        long = row_totals(size[found.ids], np.append(0, np.cumsum(found.lengths)))
        fits = long == np.diff(cuts)
        told = np.frombuffer(b"".join([names[i] for i in found.expanded(np.flatnonzero(fits)).tolist()]), np.uint8)
        differ = told != own[np.repeat(fits, np.diff(cuts))]
        same = fits.copy()
        same[fits] = row_totals(differ, np.append(0, np.cumsum(long[fits]))) == 0
        odd = row_totals(~same[chunks.which], chunks.bounds) > 0
        for row in np.flatnonzero(odd).tolist():  # chunks that differ may still join to the same bytes
            joined = found.expanded(chunks.which[chunks.bounds[row] : chunks.bounds[row + 1]])
            odd[row] = b"".join([names[i] for i in joined]) != buf[offsets[row] : offsets[row + 1]].tobytes()
        return ~odd

    def __call__(self, text: pa.Array, digest: bool) -> list[pa.Array]:
        """Columns n_a, n_b, n_groups, n_links, groups, pairs, times of a slice of texts."""
        buf, offsets = utf8(text)
        full = np.diff(offsets) > 0
        buf, offsets = spaced(buf, np.append(offsets[:-1][full], offsets[-1]))
        chunks = [chunks_of(buf, offsets, side) for side in self.sides]
        found = [coded(c.distinct, side) for c, side in zip(chunks, self.sides, strict=True)]
        whole = np.logical_and(*(self._whole(s, chunks[s], found[s], buf, offsets) for s in (0, 1)))
        parts = []
        cuts = np.flatnonzero(np.diff(offsets[1:] // SLICE_BYTES)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(whole)], strict=True):
            if e > s:
                parts.append(self._rows(s, e, chunks, found, whole, digest))
        if parts:
            *numbers, told, pairs, times = (sum(p, []) if isinstance(p[0], list) else np.concatenate(p) for p in zip(*parts, strict=True))
        else:
            *numbers, told, pairs, times = *[np.zeros(0, np.int64)] * 4, [], [], []

        def spread(values, rest, kind):
            """The values of the rows that have text, the rest for others."""
            if isinstance(values, np.ndarray):
                out = np.full(len(full), rest, np.int64)
                out[full] = values
                return pa.array(out, kind)
            own = iter(values)
            return pa.array([next(own) if f else rest for f in full.tolist()], kind)

        numbers = [spread(x, 0, pa.int64()) for x in numbers]
        return [*numbers, spread(told, "", pa.string()), spread(pairs, b"", pa.binary()), spread(times, b"", pa.binary())]

    def _rows(self, start: int, stop: int, chunks: list[Chunks], found: list[Coded], whole: np.ndarray, digest: bool):
        """n_a, n_b, n_groups, n_links, groups, pairs, times of some rows."""
        whole = whole[start:stop]
        ids, ends, counts = [], [], []
        for c, f, size in zip(chunks, found, self.sizes, strict=True):
            bounds = c.bounds[start : stop + 1]
            which = c.which[bounds[0] : bounds[-1]]
            counts.append(row_totals(f.lengths[which], bounds - bounds[0]) * whole)
            ids.append(f.expanded(which[np.repeat(whole, np.diff(bounds))]))
            ends.append(np.cumsum(size[ids[-1]]))
        links, groups = merged(*ends)
        row_of = np.repeat(np.arange(len(whole)), counts[0])
        group_row = row_of[groups[0]]
        n_groups, n_links = (np.bincount(x, minlength=len(whole)) for x in (group_row, row_of[links[0]]))
        told = self._told(ids, groups, group_row, whole, digest)
        return *counts, n_groups, n_links, told, *self._pairs(ids, links, row_of, len(whole))

    def _told(self, ids, groups, group_row, whole, digest: bool) -> list[str]:
        if not len(group_row):
            return [""] * len(whole)
        flat, stops = group_texts(*ids, groups, group_row, self.digits)
        data, cuts = flat.tobytes(), stops.tolist()
        # the sign after the last id of a row is left out
        texts = iter([data[s : e - 1] for s, e in zip(cuts[:-1], cuts[1:], strict=True)])
        told = (next(texts) if w else b"" for w in whole.tolist())
        return [hashlib.sha256(t).hexdigest() if digest and t else t.decode() for t in told]

    def _pairs(self, ids, links, row_of, rows: int) -> tuple[list[bytes], list[bytes]]:
        """Distinct linked id pairs of each row, sorted, and how often each is linked."""
        codes = len(self.names[0]) * len(self.names[1])
        pair = ids[0][links[0]] * len(self.names[1]) + ids[1][links[1]]
        order = np.lexsort((pair, row_of[links[0]]))
        row, pair = row_of[links[0]][order], pair[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(pair)))
        bounds = np.searchsorted(row[first], np.arange(rows + 1)).tolist()
        pair = pair[first].astype(pair_type(codes))
        out = [], []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            n = times[s:e]
            narrow = n.astype(np.min_scalar_type(int(n.max()))) if e > s else n[:0]
            out[0].append(pair[s:e].tobytes())
            out[1].append(narrow.tobytes())
        return out


def pair_type(codes: int) -> type:
    return np.uint32 if codes <= 1 << 32 else np.uint64


def _times(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


ROWS = "row long, {key}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def encoded(docs: DataFrame, path_a: str, path_b: str, key: str, text: str, digest: bool) -> DataFrame:
    """Per document what the merge of its ends gives."""
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    files = docs.sparkSession.sparkContext.broadcast((Vocabulary.read(path_a), Vocabulary.read(path_b)))

    def run(batches):
        aligner = None
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "__text", CHUNK_BYTES):
            aligner = aligner or Aligner(*files.value)
            n = batch.num_rows
            columns = [pa.array(np.arange(number, number + n)), batch.column(0), *aligner(batch.column(1), digest)]
            number += n
            yield pa.RecordBatch.from_arrays(
                columns, ["row", key, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
            )

    return rows.mapInArrow(run, ROWS.format(key=f"`{key}` {rows.schema[0].dataType.simpleString()}"))


def pair_counts(rows: DataFrame, codes: int, held: int = HELD_PAIRS) -> DataFrame:
    """(pair, docs): the number of rows that hold the pair."""
    kind = pair_type(codes)

    def combine(parts):
        pairs, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(pairs, kind="stable")
        pairs, n = pairs[order], n[order]
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
        return pairs[first], np.add.reduceat(n, first) if len(first) else n

    def told(pairs, n):
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "docs"])

    def run(batches):
        sure, fresh, loose = None, [], 0
        for batch in slices(batches, "pairs"):
            pairs = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), kind)
            fresh.append((pairs, np.ones(len(pairs), np.int64)))
            loose += len(pairs)
            if loose >= 2 * held:
                sure, fresh, loose = combine([*([sure] if sure else []), *fresh]), [], 0
                if len(sure[0]) >= held:
                    yield told(*sure)
                    sure = None
        if sure or fresh:
            yield told(*combine([*([sure] if sure else []), *fresh]))

    counted = rows.select("pairs").mapInArrow(run, "pair long, docs long")
    return counted.groupBy("pair").agg(F.sum("docs").alias("docs"))


def frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """The pairs of the largest counts, ``most`` at most, the others, and whether there are others.

    Counts of one bit length stay together, so the two parts are told apart by a single limit.
    """
    classes = counts.groupBy(F.length(F.bin("docs")).alias("bits")).count().collect()
    least, total = 65, 0
    for row in sorted(classes, key=lambda r: -r["bits"]):
        total += row["count"]
        if total > most:
            break
        least = row["bits"]
    wide = F.length(F.bin("docs")) >= least
    return counts.where(wide), counts.where(~wide), total > most


def aligned_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    key: str = "doc_id",
    text: str = "text",
    digest: bool = False,
    table_pairs: int = TABLE_PAIRS,
) -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    ``groups`` holds ``a1,a2|b1;a3|b2,b3`` (ids in order), or with ``digest`` its lowercase hex sha256.
    n_best counts links whose pair is in as many documents as any pair of its A id; count_sum adds
    the documents of the pair over all links.
    """
    context = docs.sparkSession.sparkContext
    rows = written(encoded(docs, path_a, path_b, key, text, digest), "alignment-rows")
    one, two = (len(Encoder(Vocabulary.read(p), plain=True).token_bytes()) for p in (path_a, path_b))
    counts = written(pair_counts(rows, one * two), "alignment-pairs")
    highest = np.zeros(one, np.int64)
    of_a = F.expr(f"pair div {two}").alias("a")
    for row in counts.groupBy(of_a).agg(F.max("docs").alias("docs")).collect():  # one row for each entry of A
        highest[row["a"]] = row["docs"]
    table, rare, some_rare = frequent(counts, table_pairs)
    table = table.toArrow().sort_by("pair")
    sent = context.broadcast((table.column("pair").to_numpy(), table.column("docs").to_numpy(), highest))
    kind = pair_type(one * two)

    def judge(batches):
        pair, docs_of, best_of = sent.value
        for batch in slices(batches, "pairs"):
            best, total, left_pairs, left_times = [], [], [], []
            for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                own = np.frombuffer(p, kind).astype(np.int64)
                times = _times(t, len(own))
                at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
                known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                n = docs_of[at[known]]
                best.append(int(times[known][n == best_of[own[known] // two]].sum()))
                total.append(int((times[known] * n).sum()))
                left_pairs.append(own[~known])
                left_times.append(times[~known])
            left = pa.array(left_pairs, pa.list_(pa.int64())), pa.array(left_times, pa.list_(pa.int64()))
            names = [c for c in batch.schema.names if c not in ("pairs", "times")]
            columns = [*(batch.column(c) for c in names), pa.array(best, pa.int64()), pa.array(total, pa.int64()), *left]
            yield pa.RecordBatch.from_arrays(columns, [*names, "best", "total", "pairs", "times"])

    schema = ROWS.format(key=f"`{key}` {rows.schema[1].dataType.simpleString()}")
    schema = schema.replace("pairs binary, times binary", "best long, total long, pairs array<long>, times array<long>")
    found = rows.mapInArrow(judge, schema)
    best, total = F.col("best"), F.col("total")
    if some_rare:
        found = written(found, "alignment-known")
        tops = counts.groupBy(of_a).agg(F.max("docs").alias("top"))
        entry = F.explode(F.arrays_zip("pairs", "times"))
        entries = found.select("row", entry.alias("e")).select("row", F.col("e.pairs").alias("pair"), "e.times")
        joined = entries.join(rare, "pair").join(tops, of_a == tops["a"])
        more = joined.groupBy("row").agg(
            F.sum(F.when(F.col("docs") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("docs") * F.col("times")).alias("more_total"),
        )
        found = found.join(more, "row", "left")
        best, total = (F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("best", "total"))
    return found.select(
        key, "n_a", "n_b", "n_groups", "n_links", best.alias("n_best"), total.alias("count_sum"), "groups"
    )
