"""Operator 8: join of near-equal documents by the Jaccard similarity of their word shingles.

Shingles are hashed into groups; the counts of a document's groups are a point. The
overlap of two documents cannot exceed the summed minima of their counts, which prunes
pairs in an R-tree and before each exact comparison.

1.  ``profiles``: one pass gives each document's set size, the class of documents with
    an equal set, its count vector, and how often shingles fall into each cell of a
    fixed table (all documents).
2.  ``shared_tokens``: a linked pair shares one of the first n/4 + 1 shingles of both, in
    any order common to all documents. The order here is by how full the shingle's
    cell is, so wide-spread passages come last. Only classes enter, once per slice of text.
3.  ``centred``: the smallest class of a shared token is its centre. Classes meet their centres in rounds: first
    the one they share most tokens with, then some more, but only centres of another
    component. Pairs within the bound are verified on whole sets, and links join components.
4.  ``remaining_pairs``: around a centre that still has several components, classes
    outside the largest one search R-trees of the others. Blocks bound what a task holds.
    Each search gives the candidates of the largest bounds first; their pairs are verified and joined. Classes that had
    more search again for more until none is left out, so every pair within the bound is tried or already joined.
5.  The components of all links are the result.

In each step links join components, not classes, and each task keeps a spanning forest of its links. Two classes in
one component need no further comparison, so a group of thousands of near copies costs a few comparisons for each
member, not one for each pair or for each centre.

Null or wordless texts have no shingles, no links and form their own component.
Rows may repeat: equal rows are one class. Columns other than the key and text are
not read. An empty table gives an empty result. Null keys count as a key of their own
and never name a component with others; their texts link like any other. Equality of
classes and shingles is that of 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navette.llm.common import SMALL_SLICE_BYTES, as_blocks, components, forest, mix, slices, summed, utf8, written
from navette.llm.count_tree import FINE_GROUPS, GROUPS, LARGE, CountTree, count_vectors, least_overlap, overlap_bound
from navette.llm.shingles import row_sums, shingle_sets

PERCENT = 75
#: Cells of the table that orders shingles from rare to frequent.
CELLS = 1 << 18
#: Rows of one token that go to one task; a token well above the mean is dealt over several.
SPREAD = 65_536
#: Centres that a class has met after each round of stars, those with most shared tokens first.
STAR_ROUNDS = (1,)
#: Candidates of a class from one tree in the first search, and how much more in each further one, until all were given.
NEAREST, MORE = 16, 64
#: Classes in one R-tree of the last search.
BLOCK = 4096
#: Pairs of two numbers that may be sent to all executors; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 500_000
#: Keys of dropped documents that may be sent to all executors; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000

_PROFILE = "doc_id long, n long, cls long, vec binary, block int, part binary"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _classes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return mix(row_sums(hashes, bounds) + np.diff(bounds).astype(np.uint64))


def profiles(docs: DataFrame) -> DataFrame:
    """Set size, class and count vector of each document; rows with a block hold cell counts.

    The count vector of a large set is followed by its longer one.
    """

    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            hashes, bounds = shingle_sets(*utf8(batch.column("text")))
            cells += np.bincount((hashes % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
            n = np.diff(bounds)
            cls = _classes(hashes, bounds)
            none = n == 0
            vectors = [v.tobytes() for v in count_vectors(hashes, bounds)]
            for row in np.flatnonzero(n >= LARGE).tolist():
                one = hashes[bounds[row] : bounds[row + 1]]
                vectors[row] += count_vectors(one, np.array([0, len(one)]), FINE_GROUPS).tobytes()
            columns = [
                batch.column("doc_id"),
                pa.array(n),
                pa.array(cls.view(np.int64), mask=none),
                pa.array(vectors, pa.binary(), mask=none),
                pa.nulls(len(n), pa.int32()),
                pa.nulls(len(n), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "cls", "vec", "block", "part"])
        blocks = as_blocks(cells)
        empty = [pa.nulls(blocks.num_rows, t) for t in (*[pa.int64()] * 3, pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*empty, *blocks.columns], ["doc_id", "n", "cls", "vec", "block", "part"]
        )

    return docs.mapInArrow(run, _PROFILE)


def shared_tokens(docs: DataFrame, cells: np.ndarray, percent: int, spread: int = SPREAD) -> DataFrame:
    """(token, cls) for tokens among the first ones of at least two classes."""
    usual = 2 * int(cells.mean())

    def run(batches):
        grade = np.array([int(c).bit_length() for c in cells], np.uint64) << np.uint64(58)
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            hashes, bounds = shingle_sets(*utf8(batch.column("text")))
            cls = _classes(hashes, bounds)
            size = np.diff(bounds)
            once = np.zeros(len(size), bool)
            once[np.unique(cls, return_index=True)[1]] = True
            rank = grade[(hashes % np.uint64(CELLS)).astype(np.int64)] | (hashes >> np.uint64(6))
            tokens, owners = [], []
            for row in np.flatnonzero(once & (size > 0)).tolist():
                a, b = bounds[row], bounds[row + 1]
                first = int(b - a) - -(-percent * int(b - a) // 100) + 1
                order = np.argsort(rank[a:b], kind="stable")[:first]
                tokens.append(hashes[a:b][order])
                owners.append(np.full(first, cls[row]))
            if not tokens:
                continue
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            over = np.maximum(cells[(token % np.uint64(CELLS)).astype(np.int64)] - usual, 0)
            salt = (owner % (1 + over // spread).astype(np.uint64)).astype(np.int32)
            salted = np.where(over >= spread, salt, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_signed(token), pa.array(salted), _signed(owner)], ["token", "salt", "cls"])

    found = docs.mapInArrow(run, "token long, salt int, cls long")
    group = Window.partitionBy("token", "salt")
    found = found.withColumns({"low": F.min("cls").over(group), "high": F.max("cls").over(group)})
    # a dealt token is frequent, so all its parts count as shared
    return found.where("low < high or salt >= 0").select("token", "salt", "cls").distinct().select("token", "cls")


def within_bound(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose count vectors allow the similarity."""
    sized = classes.select("cls", "n", F.substring("vec", 1, GROUPS).alias("vec"))
    sides = [sized.select([F.col(c).alias(f"{side}_{c}") for c in ("cls", "n", "vec")]) for side in "ab"]
    joined = pairs.join(sides[0], F.col("a") == F.col("a_cls")).join(sides[1], F.col("b") == F.col("b_cls"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(f"{s}_n").to_numpy() for s in "ab")
            u, v = (_vectors(batch.column(f"{s}_vec")) for s in "ab")
            keep = overlap_bound(u, v) >= least_overlap(n, m, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = joined.where("100 * least(a_n, b_n) >= {0} * greatest(a_n, b_n)".format(percent))
    return joined.select("a", "b", "a_n", "b_n", "a_vec", "b_vec").mapInArrow(run, "a long, b long")


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v[:GROUPS] for v in column.to_pylist()), np.uint8).reshape(len(column), -1)


def _finer(column: pa.Array) -> list[np.ndarray | None]:
    return [np.frombuffer(v, np.uint8)[GROUPS:] if len(v) > GROUPS else None for v in column.to_pylist()]


def whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, fine: bool) -> DataFrame:
    """(cls, shingles) of the wanted classes, read from one document of each; without a key, found by their class.

    ``fine``: of each hash only the group among 65,536, with repeats, a quarter of the size.
    """
    known = written(classes.join(wanted, "cls").select("cls", F.col("rep").alias("doc_id")), "ngram-wanted")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)

    def run(batches):
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            hashes, bounds = shingle_sets(*utf8(batch.column("text")))
            cls = pa.array(_classes(hashes, bounds).view(np.int64))
            # the class asked for; documents without a key are asked for none and tell theirs
            asked = batch.column("cls")
            same = pc.fill_null(pc.equal(asked, cls), True)
            kept = (hashes >> np.uint64(48)).astype(np.uint16) if fine else hashes
            sets = [kept[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            out = pa.RecordBatch.from_arrays([cls, pa.array(sets, pa.binary())], ["cls", "shingles"])
            yield out.filter(same)

    keyed = docs.join(known, "doc_id").select("cls", "text").mapInArrow(run, "cls long, shingles binary")
    # matching null with null would pair every such document with every such class
    bare = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("cls"), "text")
    bare = bare.mapInArrow(run, "cls long, shingles binary").join(known.where("doc_id is null").select("cls"), "cls")
    return keyed.union(bare).dropDuplicates(["cls"])


def compared(pairs: DataFrame, sets: DataFrame, percent: int, fine: bool) -> DataFrame:
    """Pairs whose sets reach the similarity; with fine groups, whose summed minima allow it."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))

    def common(u, v):
        if fine:
            return int(np.minimum(np.bincount(u, minlength=1 << 16), np.bincount(v, minlength=1 << 16)).sum())
        both = np.concatenate([u, v])
        both.sort()
        return int((both[1:] == both[:-1]).sum())

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint16 if fine else np.uint64) for z in (x, y))
                shared = common(u, v)
                keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the similarity: first by a finer count vector, then by the sets themselves."""
    for fine in (True, False):
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        sets = written(whole_sets(docs, classes, ends, fine), "ngram-sets")
        pairs = written(compared(pairs, sets, percent, fine), "ngram-links")
    return pairs


def centred(tokens: DataFrame) -> DataFrame:
    """(centre, cls, place): classes by the smallest class of a token they are in, itself included.

    Many tokens have one centre, so a pair of classes meets about once, not once for each shared token. The place
    orders the other centres of a class, the one with most shared tokens first.
    """
    centre = tokens.groupBy("token").agg(F.min("cls").alias("centre"))
    groups = tokens.join(centre, "token").groupBy("centre", "cls").agg(F.count("*").alias("shared"))
    # a class has no more centres than tokens, a quarter of its set
    own = Window.partitionBy("cls").orderBy(F.col("centre") == F.col("cls"), F.col("shared").desc(), "centre")
    return groups.withColumn("place", F.row_number().over(own)).select("centre", "cls", "place")


def star_pairs(groups: DataFrame, found: DataFrame, after: int, upto: int) -> DataFrame:
    """(a, b): classes with centres of other components, by the places after the first limit up to the second."""
    stars = groups.where((F.col("cls") != F.col("centre")) & (F.col("place") > after) & (F.col("place") <= upto))
    stars = stars.select(F.col("centre").alias("a"), F.col("cls").alias("b"))
    if not after:
        return stars
    for end in "ab":
        part = found.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}"))
        stars = stars.join(part, end, "left").withColumn(f"part_{end}", F.coalesce(f"part_{end}", end))
    return stars.where("part_a <> part_b").select("a", "b")


def remaining_pairs(
    groups: DataFrame, classes: DataFrame, found: DataFrame, percent: int, block: int = BLOCK, most: int = 1 << 62,
    again: DataFrame | None = None,
) -> DataFrame:
    """(a, b, centre): pairs (a < b) of different components that share a centre and stay within the bound.

    A class gets ``most`` candidates from a tree, those with the most overlap to spare. Where there were more, a row
    without b tells the class (a) and its centre. ``again`` has such (centre, cls) of the search before: only they ask
    then, as a pair not given before has one of them.
    """
    placed = groups.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left")
    placed = placed.select("centre", "cls", F.coalesce("component", "cls").alias("comp"))
    parts = placed.groupBy("centre", "comp").agg(F.count("*").alias("size"))
    spread = parts.groupBy("centre").agg(
        F.max_by("comp", F.struct("size", "comp")).alias("largest"),
        F.sum("size").alias("total"),
        F.count("*").alias("parts"),
    )
    spread = spread.where("parts > 1").select("centre", "largest", F.ceil(F.col("total") / block).cast("int").alias("n_blocks"))
    rows = placed.join(spread, "centre")
    if again is None:
        asking = rows.where("comp <> largest")
    else:
        asking = rows.join(again, ["centre", "cls"], "left_semi")
        rows = rows.join(again.select("centre").distinct(), "centre", "left_semi")
    indexed = rows.select(
        "centre", F.expr("int(pmod(xxhash64(cls), n_blocks))").alias("piece"), F.lit(0).alias("asks"), "cls", "comp"
    )
    asking = asking.select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("piece"), F.lit(1).alias("asks"), "cls", "comp"
    )
    sized = classes.select("cls", "n", "vec")
    dealt = indexed.union(asking).join(sized, "cls")
    dealt = dealt.select("centre", "piece", "asks", "cls", "comp", "n", "vec")
    dealt = dealt.repartition("centre", "piece").sortWithinPartitions("centre", "piece", "asks", "cls")

    def run(batches):
        held: dict = {"key": None}

        def answer(rows):
            """Index rows come first; questions may arrive over several calls."""
            group, asks, cls, comp, n, vec, finer = rows
            if held["key"] != group:
                held.update(key=group, index=[], tree=None)
            if not asks[0]:
                held["index"].append((cls, comp, n, vec, finer))
                return None
            if held["tree"] is None:
                if not held["index"]:
                    return None
                *columns, long = zip(*held["index"], strict=True)
                c, k, m, v = (np.concatenate(x) for x in columns)
                held.update(cls=c, comp=k, tree=CountTree(v, m, [f for part in long for f in part]), index=[])
            a, b, cut = [], [], []
            for i in range(len(cls)):
                hits, spare = held["tree"].search(vec[i], int(n[i]), percent, finer[i])
                other = held["comp"][hits] != comp[i]
                hits, spare = held["cls"][hits[other]], spare[other]
                if len(hits) > most:
                    cut.append(int(cls[i]))
                    hits = hits[np.lexsort((hits, -spare))[:most]]
                a.append(np.minimum(hits, cls[i]))
                b.append(np.maximum(hits, cls[i]))
            more = [cut, [None] * len(cut), [group[0]] * len(cut)]
            pairs = [np.concatenate(a), np.concatenate(b), pa.nulls(sum(map(len, a)), pa.int64())]
            return [pa.concat_arrays([pa.array(x), pa.array(y, pa.int64())]) for x, y in zip(pairs, more, strict=True)]

        for batch in batches:
            if not batch.num_rows:
                continue
            centre, piece, asks, cls, comp, n = (batch.column(i).to_numpy() for i in range(6))
            vec, finer = _vectors(batch.column("vec")), _finer(batch.column("vec"))
            new = np.flatnonzero(
                np.concatenate([[True], (centre[1:] != centre[:-1]) | (piece[1:] != piece[:-1]) | (asks[1:] != asks[:-1])])
            ).tolist()
            out = []
            for s, e in zip(new, [*new[1:], len(centre)], strict=True):
                key = (int(centre[s]), int(piece[s]))
                got = answer((key, asks[s:e], cls[s:e], comp[s:e], n[s:e], vec[s:e], finer[s:e]))
                if got is not None:
                    out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], ["a", "b", "centre"])

    return dealt.mapInArrow(run, "a long, b long, centre long").distinct()


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) when links between nodes join the components found before."""
    ends = links.select("a", "b")
    for end in "ab":
        part = found.select(F.col("node").alias(end), F.col("component").alias("__part"))
        ends = ends.join(part, end, "left").withColumn(end, F.coalesce("__part", end)).drop("__part")
    more = components(forest(ends.where("a <> b").distinct()), "ngram-joined")
    above = more.select(F.col("node").alias("component"), F.col("component").alias("__above"))
    moved = found.join(above, "component", "left").select("node", F.coalesce("__above", "component").alias("component"))
    # nodes without a component so far
    return moved.union(more.join(found, "node", "left_anti").select("node", "component"))


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document: key, n_shingles, component_id (smallest linked key),
    root (class that stands for the group) and cls (the document's own class)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = written(profiles(docs), "ngram-profiles")
    cells = summed(profile.where("block is not null"), "int64")
    if cells is None:
        cells = np.zeros(CELLS, np.int64)
    rows = profile.where("block is null")
    classes = rows.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("vec").alias("vec")
    )
    classes = written(classes, "ngram-classes")
    tokens = written(shared_tokens(docs, cells, percent), "ngram-tokens")
    groups = written(centred(tokens), "ngram-groups")
    found = docs.sparkSession.createDataFrame([], "node long, component long")
    tried, after = [], 0
    for upto in STAR_ROUNDS:
        pairs = written(within_bound(star_pairs(groups, found, after, upto), classes, percent), "ngram-pairs")
        tried.append(pairs)
        found = written(joined_components(found, verified(docs, classes, pairs, percent)), "ngram-components")
        after = upto
    most, again, cut = NEAREST, None, True
    while cut:
        rest = written(remaining_pairs(groups, classes, found, percent, most=most, again=again), "ngram-rest")
        again = rest.where("b is null").select("centre", F.col("a").alias("cls"))
        cut = not again.isEmpty()
        known = reduce(DataFrame.union, tried).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = written(rest.where("b is not null").select("a", "b").join(known, ["a", "b"], "left_anti"), "ngram-untried")
        tried.append(rest)
        links = rest if rest.isEmpty() else verified(docs, classes, rest, percent)
        if not links.isEmpty():
            found = written(joined_components(found, links), "ngram-components")
        most *= MORE
    roots = classes.select("cls", "rep").join(found.withColumnRenamed("node", "cls"), "cls", "left")
    roots = roots.select("cls", "rep", F.coalesce("component", "cls").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = roots.join(least, "root").select("cls", "root", "component_id")
    result = rows.select("doc_id", "n", "cls").join(named, "cls", "left")
    return result.select(
        F.col("doc_id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "root",
        "cls",
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each group one row with the smallest key stays.

    Wordless rows all stay. Rows that share a key are told apart by their class of equal sets.
    """
    placed = ngram_components(docs, key, text).select(
        F.col(key).alias("__key"),
        F.col("cls").alias("__own"),
        F.col("root").alias("__root"),
        F.col(key).eqNullSafe(F.col("component_id")).alias("__kept"),
    )
    placed = written(placed.distinct(), "ngram-placed")
    several = docs.groupBy(F.col(key).alias("__key")).count().where("count > 1 or __key is null").select("__key")
    several = written(several, "ngram-several")
    gone = written(placed.where("not __kept").select("__key").union(several).where("__key is not null").distinct(), "ngram-gone")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    once = docs.where(F.col(key).isNotNull()).join(gone, F.col(key) == F.col("__key"), "left_anti")
    if several.isEmpty():
        return once

    @F.pandas_udf("long")
    def class_of(texts):
        out = [pd.Series([], dtype="Int64")]
        whole = pa.RecordBatch.from_arrays([pa.Array.from_pandas(texts, type=pa.string())], ["text"])
        for piece in slices([whole], most=SMALL_SLICE_BYTES):
            hashes, bounds = shingle_sets(*utf8(piece.column("text")))
            cls = _classes(hashes, bounds)
            out.append(pd.Series(cls.view(np.int64)).where(np.diff(bounds) > 0).astype("Int64"))
        return pd.concat(out, ignore_index=True)

    same = F.col(key).eqNullSafe(F.col("__key"))
    # written, so that the class is worked out for these rows only
    again = written(docs.join(several, same, "left_semi"), "ngram-again")
    again = again.withColumn("__cls", class_of(F.col(text).cast("string")))
    wordless = again.where("__cls is null").select(docs.columns)
    chosen = again.join(placed.where("__kept"), same & (F.col("__cls") == F.col("__own")))
    chosen = chosen.dropDuplicates(["__root"]).select(docs.columns)
    return once.union(wordless).union(chosen)
