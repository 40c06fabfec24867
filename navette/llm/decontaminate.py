"""Operator 9: documents that hold a benchmark item up to a few edits.

An item of n characters may differ by ``n // EDIT_SHARE`` edits. Cut into one piece
more than that, at least one piece of every such occurrence is unchanged. An
Aho-Corasick automaton finds pieces in whole texts; around each hit the item's
bit-parallel edit distance (Myers) decides.

Items and texts are compared lower-cased and with each run of white space as one
space. Null and empty texts and items match nothing; items whose pieces would be
shorter than ``LEAST_PIECE`` get fewer edits, down to none. Equal items are matched
once and reported under each of their ids; ids may be of any type. The items are the query set: they are
dealt into blocks by a hash of their text and taken to the tasks one block at a time, each a pass over the documents
whose result is written before the next block is fetched. So the driver and a task hold one block, of about
``BLOCK_CHARS`` characters or one longer item, however large the benchmark is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navette.llm.common import written

#: One edit is allowed for each so many characters of an item.
EDIT_SHARE = 20
LEAST_PIECE = 12
#: Characters of items that one pass over the documents takes.
BLOCK_CHARS = 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edits_allowed(length: int, share: int = EDIT_SHARE) -> int:
    return min(length // share, max(length // LEAST_PIECE - 1, 0))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 parts of nearly equal length, with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def least_distance(item: str, window: str, most: int) -> int | None:
    """Smallest edit distance of the item to any part of the window, by Myers' bit vectors; None above ``most``."""
    ones = (1 << len(item)) - 1
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    up, down, score, best = ones, 0, len(item), len(item)
    top = 1 << (len(item) - 1)
    for c in window:
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        right = down | ~(across | up)
        left = up & across
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1) & ones
        left = (left << 1) & ones
        seen = eq | down
        up = (left | ~(seen | right)) & ones
        down = right & seen
        best = min(best, score)
    return best if best <= most else None


class ItemFinder:
    """Finds items in texts; built from (item_id, text) rows."""

    def __init__(self, items: list[tuple[int, str]], share: int = EDIT_SHARE):
        by_text = defaultdict(list)
        for item_id, text in items:
            if normal(text):
                by_text[normal(text)].append(item_id)
        self.items = [(text, edits_allowed(len(text), share), ids) for text, ids in by_text.items()]
        found = defaultdict(list)
        for k, (text, edits, _) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                found[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of the items in the text, the smallest distance each."""
        if not self.items:
            return []
        text = normal(text)
        # starts an occurrence may have, per item
        spots = defaultdict(set)
        for end, (length, places) in self.automaton.iter(text):
            for k, at in places:
                spots[k].add(end + 1 - length - at)
        out = []
        for k, begins in spots.items():
            item, edits, ids = self.items[k]
            best = None
            if any(text.startswith(item, b) for b in begins if b >= 0):
                best = 0
            elif edits:
                for a, b in _merged(begins, edits, len(item)):
                    got = least_distance(item, text[max(a, 0) : b], edits)
                    if got is not None and (best is None or got < best):
                        best = got
            if best is not None:
                out += [(i, best) for i in ids]
        return out


def _merged(begins: set[int], edits: int, length: int) -> list[list[int]]:
    """Windows that hold any occurrence near the starts; overlapping ones joined."""
    out: list[list[int]] = []
    for b in sorted(begins):
        a, z = b - edits, b + length + edits
        if out and a <= out[-1][1]:
            out[-1][1] = z
        else:
            out.append([a, z])
    return out


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> tuple[DataFrame, int]:
    """(item_id, text, block) of all items with text, and how many blocks of about so many characters there are."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // chars)
    return items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(blocks, 1)))), blocks


def _block(items: DataFrame, number: int) -> list[tuple]:
    return [(r.item_id, r.text) for r in items.where(F.col("block") == number).collect()]


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: int = EDIT_SHARE,
    chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(key, item_id, distance) of each benchmark item found in a document; one row for each document row and item.

    Of several blocks each writes its rows to the shared folder before the next one starts.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {id_type.simpleString()}, distance int"
    arrow_type = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    items, blocks = item_blocks(benchmark, chars)
    parts = []
    for number in range(blocks):
        part = docs.mapInArrow(_finding(_block(items, number), share, arrow_type), schema)
        parts.append(written(part, f"leaks-{number}") if blocks > 1 else part)
    if not parts:
        parts = [docs.where("false").select("doc_id", F.lit(None).cast(id_type).alias("item_id"), F.lit(0).alias("distance"))]
    return reduce(DataFrame.union, parts).withColumnRenamed("doc_id", key)


def _finding(block: list[tuple], share: int, arrow_type: pa.DataType):
    def run(batches):
        finder = ItemFinder(block, share)
        for batch in batches:
            rows = [
                (i, item, distance)
                for i, value in enumerate(batch.column("text").to_pylist())
                for item, distance in finder(value)
            ]
            at = pa.array([r[0] for r in rows], pa.int64())
            items = pa.array([r[1] for r in rows], arrow_type)
            found = [batch.column("doc_id").take(at), items, pa.array([r[2] for r in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays(found, ["doc_id", "item_id", "distance"])

    return run


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", share: int = EDIT_SHARE, chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents in which no benchmark item is found.

    Of several blocks each but the last writes what it keeps to the shared folder.
    """
    items, blocks = item_blocks(benchmark, chars)
    for number in range(blocks):
        docs = docs.where(~_leaking(_block(items, number), share)(F.col(text).cast("string")))
        if number + 1 < blocks:
            docs = written(docs, f"unleaked-{number}")
    return docs


def _leaking(block: list, share: int):
    @F.pandas_udf("boolean")
    def leaking(batches: "Iterator[pd.Series]") -> "Iterator[pd.Series]":
        finder = ItemFinder(block, share)
        for texts in batches:
            yield pd.Series([bool(finder(t)) for t in texts], dtype=bool)

    return leaking
