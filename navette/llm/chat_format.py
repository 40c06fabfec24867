"""Operator 2: conversations as one formatted text each, with the part that carries loss.

A turn becomes ``### role:\\n text </turn>\\n``. Inside roles and texts a backslash
precedes every backslash, ``#``, ``<``, ``:`` and line break of a role, and every backslash,
``#`` and ``<`` of a text, so control strings never occur in them and the original comes back by dropping
those backslashes. Loss spans (code points of the formatted text) cover the escaped text of
each assistant turn.

Formatting is columnar: lengths of all headers, texts and footers of a batch give
cumulative offsets, and the bytes are copied by scatter indices into one buffer,
allocated once, that becomes an Arrow column.

Turns are ordered by turn, nulls first, ties by role and text. Null texts and roles count as empty;
a null conversation id is a conversation of its own; repeated rows are repeated turns; extra columns
are not read. An empty table gives an empty result. A conversation is one value, so it is built in one
task, and its formatted text has at most 2 GiB, as any value of Spark; conversations are dealt by their id and
formatted in batches bounded by bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navette.llm.common import slices, utf8, whole_groups

#: Turns or bytes of turns that are formatted at once; a longer conversation is formatted alone.
TURNS_AT_ONCE = 4000
BYTES_AT_ONCE = 8 << 20

HEAD, AFTER_ROLE, FOOT = b"### ", b":\n", b"</turn>\n"
ASSISTANT = "assistant"

_TEXT_ESCAPES = np.zeros(256, bool)
_TEXT_ESCAPES[list(b"\\#<")] = True
_ROLE_ESCAPES = _TEXT_ESCAPES.copy()
_ROLE_ESCAPES[list(b":\n")] = True


def escaped(buf: np.ndarray, offsets: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a backslash before each special one, and the new offsets."""
    marked = special[buf]
    before = np.concatenate([[0], np.cumsum(marked)])
    out = np.full(len(buf) + int(before[-1]), ord("\\"), np.uint8)
    out[np.arange(len(buf)) + before[1:]] = buf
    return out, offsets + before[offsets]


def scatter(out: np.ndarray, at: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> None:
    """Copy each row of bytes to its place."""
    length = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], length) + np.arange(offsets[-1])] = buf[: offsets[-1]]


def _repeat(value: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(value, np.uint8), n), np.arange(n + 1) * len(value)


def code_points(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return starts[offsets[1:]] - starts[offsets[:-1]]


def format_turns(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations, sorted, as formatted texts with loss spans."""
    table = table.combine_chunks()
    n = table.num_rows
    column = lambda name: table.column(name).chunk(0)
    roles = escaped(*utf8(column("role")), _ROLE_ESCAPES)
    texts = escaped(*utf8(column("text")), _TEXT_ESCAPES)
    segments = [_repeat(HEAD, n), roles, _repeat(AFTER_ROLE, n), texts, _repeat(FOOT, n)]
    lengths = np.array([np.diff(offsets) for _, offsets in segments])
    ends = np.cumsum(lengths, axis=0)
    turn_offsets = np.concatenate([[0], np.cumsum(ends[-1])])
    out = np.empty(turn_offsets[-1], np.uint8)
    for (buf, offsets), end, length in zip(segments, ends, lengths, strict=True):
        scatter(out, turn_offsets[:-1] + end - length, buf, offsets)

    conversation = column("conv_id")
    values = conversation.fill_null(0).to_numpy(zero_copy_only=False)
    nulls = conversation.is_null().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1])]))
    bounds = np.append(first, n)
    formatted = pa.Array.from_buffers(
        pa.large_string(), len(first), [None, pa.py_buffer(turn_offsets[bounds].astype(np.int64)), pa.py_buffer(out)]
    ).cast(pa.string())

    points = np.concatenate([[0], np.cumsum(code_points(out, turn_offsets))])
    head_points = len(HEAD) + len(AFTER_ROLE) + code_points(*roles)
    group = np.repeat(np.arange(len(first)), np.diff(bounds))
    begin = points[:-1] + head_points - points[bounds[group]]
    end = begin + code_points(*texts)
    trained = np.flatnonzero(column("role").fill_null("").to_numpy(zero_copy_only=False) == ASSISTANT)
    spans = pa.StructArray.from_arrays([pa.array(begin[trained]), pa.array(end[trained])], ["begin", "end"])
    cuts = np.searchsorted(trained, bounds).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [conversation.take(pa.array(first)), formatted, pa.ListArray.from_arrays(pa.array(cuts), spans)],
        ["conv_id", "formatted", "loss"],
    )


def formatted_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) from rows (conv_id, turn, role, text)."""
    turns = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        for table in whole_groups(slices(batches), ["conv_id"], TURNS_AT_ONCE, BYTES_AT_ONCE):
            yield format_turns(table)

    return dealt.mapInArrow(run, "conv_id long, formatted string, loss array<struct<begin: long, end: long>>")


def plain(text: str) -> str:
    """Without escapes."""
    out, at = [], 0
    while (mark := text.find("\\", at)) >= 0:
        out += [text[at:mark], text[mark + 1 : mark + 2]]
        at = mark + 2
    return "".join(out) + text[at:]


def _unescaped(text: str, what: str, at: int) -> int:
    """Place of a control string from ``at``; escapes are stepped over."""
    while True:
        found, mark = text.find(what, at), text.find("\\", at)
        if mark < 0 or found < mark:
            return found
        at = mark + 2


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read from the formatted text."""
    turns, at = [], 0
    head, after, foot = HEAD.decode(), AFTER_ROLE.decode(), FOOT.decode()
    while at < len(formatted):
        role_end = _unescaped(formatted, after, at)
        text_end = _unescaped(formatted, foot, role_end + len(after))
        role = formatted[at + len(head) : role_end]
        turns.append((plain(role), plain(formatted[role_end + len(after) : text_end])))
        at = text_end + len(foot)
    return turns


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted texts hold: turns, text under the loss mask, and sizes."""

    def run(batches):
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parsed(formatted)
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(plain(formatted[s["begin"] : s["end"]]) for s in spans)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (told, loss)]
                rows.append((len(turns), digests[0], len(loss), digests[1], len(formatted)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names)

    return chats.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
