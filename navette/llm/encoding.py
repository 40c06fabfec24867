"""Texts cut at safe boundaries and encoded by a public tokenizer, each distinct chunk of a slice once.

A boundary is safe where no token of the whole text can cross it, and where both sides encode
as they do in the whole text. It depends on the tokenizer:

* words with dropped white space: before any ASCII space, tab or line feed;
* byte-level words that carry their space: before a space that follows and precedes something that is
  not white space (where special strings are plain text, what precedes it does not matter);
* pieces that carry their space: before the first of some spaces, if no piece of the vocabulary holds a
  space after another character. The space itself is left out: the library puts one before each chunk;
* any other tokenizer: none, texts are encoded whole.

A chunk longer than a batch is encoded alone, so memory is bounded by a slice of texts or one such chunk.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of distinct chunks that the library takes at once.
BATCH_BYTES = 1 << 18
#: Bytes of text whose chunks are told apart at once: the more, the fewer are distinct.
SLICE_BYTES = 8 << 20
#: Chunks that are encoded as one text where that cannot change their tokens; each call costs more than a chunk.
JOINED = 200

# Fixed value: the pattern of words without white space that chunks may be cut for.
_WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A]] = True
#: Bytes that may begin, or end, a character of white space.
_MAY_BEGIN_SPACE = np.zeros(256, bool)
_MAY_BEGIN_SPACE[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MAY_END_SPACE = np.zeros(256, bool)
_MAY_END_SPACE[[*range(0x21), 0x7F, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer's file, read by the driver, so that executors need no copy of it."""

    data: bytes
    kind: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """``path`` ends in ``.json`` (tokenizers) or ``.model`` (sentencepiece)."""
        kind = path.rpartition(".")[2]
        if kind not in ("json", "model"):
            raise ValueError(f"{path}: neither .json nor .model")
        with open(path, "rb") as file:
            return cls(file.read(), kind)


def byte_level() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: printable ones stand for themselves, others follow 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """The tokenizer in a task. ``plain``: special strings inside texts are ordinary text."""

    def __init__(self, vocabulary: Vocabulary, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.plain = plain
        self.sizes: np.ndarray | None = None
        #: Texts come with a space before them, which the library adds itself and chunks leave out.
        self.adds_space = vocabulary.kind == "model"
        if self.adds_space:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.data)
            names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
            probe = " ﬁ  a "
            as_is = self.library.normalize(probe) == "▁" + probe.replace(" ", "▁")
            inner = any("▁" in name.lstrip("▁") for name in names)
            self.cut = self._before_first_space if as_is and not inner else self._nowhere
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        self.cut = {"words": self._before_blank, "bytes": self._between_words, None: self._nowhere}[
            _boundaries(json.loads(vocabulary.data))
        ]

    def ids(self, chunks: list[str]) -> list[list[int]]:
        if self.adds_space:
            return self.library.encode(chunks, num_threads=1)
        if self.plain and self.cut == self._between_words:
            return self._joined_ids(chunks)
        return [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _joined_ids(self, chunks: list[str]) -> list[list[int]]:
        """Chunks that may follow any other are joined, and their ids told apart by the bytes of tokens."""
        if self.sizes is None:
            self.sizes = np.fromiter(map(len, self.token_bytes()), np.int64)
        follows = [len(c) > 1 and c[0] == " " and not c[1].isspace() for c in chunks]
        free = [i for i, f in enumerate(follows) if f]
        groups = [free[i : i + JOINED] for i in range(0, len(free), JOINED)]
        texts = ["".join(chunks[i] for i in group) for group in groups]
        alone = [i for i, f in enumerate(follows) if not f]
        found = self.library.encode_batch_fast([*texts, *(chunks[i] for i in alone)], add_special_tokens=False)
        out: list[list[int]] = [[]] * len(chunks)
        for group, one in zip(groups, found, strict=False):
            ids = one.ids
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([len(chunks[i].encode()) for i in group])
            cuts = np.searchsorted(ends, wanted) + 1
            if len(ids) < cuts[-1] or (ends[cuts - 1] != wanted).any():  # not the bytes of the text
                for i, e in zip(group, self.library.encode_batch_fast([chunks[i] for i in group], add_special_tokens=False), strict=True):
                    out[i] = e.ids
                continue
            for i, s, e in zip(group, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                out[i] = ids[s:e]
        for i, one in zip(alone, found[len(groups) :], strict=True):
            out[i] = one.ids
        return out

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        if self.adds_space:
            names = [(i, self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())]
            return [
                bytes([int(name[3:5], 16)]) if self.library.is_byte(i) else name.replace("▁", " ").encode()
                for i, name in names
            ]
        value = byte_level()
        out = [b""] * (max(self.library.get_vocab(True).values()) + 1)
        for name, i in self.library.get_vocab(True).items():
            known = all(c in value for c in name)
            out[i] = bytes(value[c] for c in name) if known else name.encode()
        return out

    @staticmethod
    def _nowhere(buf: np.ndarray) -> np.ndarray:
        return np.zeros(len(buf), bool)

    @staticmethod
    def _before_blank(buf: np.ndarray) -> np.ndarray:
        return _BLANK[buf]

    def _between_words(self, buf: np.ndarray) -> np.ndarray:
        cut = buf == 0x20
        cut[:-1] &= ~_MAY_BEGIN_SPACE[buf[1:]]
        if not self.plain:
            cut[1:] &= ~_MAY_END_SPACE[buf[:-1]]
        return cut

    @staticmethod
    def _before_first_space(buf: np.ndarray) -> np.ndarray:
        cut = buf == 0x20
        # 0x81 ends the sign that pieces have for a space
        cut[1:] &= (buf[:-1] != 0x20) & (buf[:-1] != 0x81)
        return cut


def _boundaries(file: dict) -> str | None:
    """Which chunks a ``tokenizers`` file allows."""
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n") for t in file["added_tokens"]):
        return None
    parts = file["pre_tokenizer"] or {}
    parts = parts.get("pretokenizers", [parts])
    if [p.get("type") for p in parts] == ["ByteLevel"]:
        own = file["normalizer"] is None and parts[0]["use_regex"] and not parts[0]["add_prefix_space"]
        return "bytes" if own else None
    first = parts[0]
    if (
        [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and (first["pattern"], first["behavior"], first["invert"]) == ({"Regex": _WORDS_ONLY}, "Removed", True)
        and not (parts[1]["use_regex"] or parts[1]["add_prefix_space"])
    ):
        return "words"
    return None


@dataclass
class Chunks:
    """Chunks of the rows of a slice: the distinct ones, which one each is, and the chunks of each row."""

    distinct: pa.Array
    which: np.ndarray
    bounds: np.ndarray


def chunks_of(buf: np.ndarray, offsets: np.ndarray, encoder: Encoder) -> Chunks:
    """The rows cut where the encoder allows it. For one that adds a space, each row begins with one."""
    begins = encoder.cut(buf)
    filled = offsets[:-1] < offsets[1:]
    begins[offsets[1:][filled] - 1] = False
    begins[offsets[:-1][filled]] = True
    start = np.flatnonzero(begins)
    bounds = np.searchsorted(start, offsets)
    if encoder.adds_space:
        keep = np.ones(len(buf), bool)
        keep[start] = False
        buf, start = buf[keep], start - np.arange(len(start))
    ends = np.append(start, len(buf)).astype(np.int64)
    data = np.ascontiguousarray(buf)
    texts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data))
    coded = texts.dictionary_encode()
    return Chunks(coded.dictionary, coded.indices.to_numpy().astype(np.int64), bounds)


def batches_of(distinct: pa.Array, most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The chunks in order, in batches of about ``most`` bytes."""
    if not len(distinct):
        return
    sizes = pc.binary_length(distinct).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(distinct)], strict=True):
        yield distinct.slice(start, stop - start).to_pylist()


@dataclass
class Coded:
    """Ids of distinct chunks, one after the other."""

    ids: np.ndarray
    lengths: np.ndarray

    def expanded(self, which: np.ndarray) -> np.ndarray:
        """Ids of a sequence of chunks."""
        n = self.lengths[which]
        first = (np.cumsum(self.lengths) - self.lengths)[which]
        return self.ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def coded(distinct: pa.Array, encoder: Encoder) -> Coded:
    parts, lengths = [], []
    for texts in batches_of(distinct):
        found = encoder.ids(texts)
        n = np.fromiter(map(len, found), np.int64, len(found))
        lengths.append(n)
        parts.append(np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())))
    none = np.zeros(0, np.int64)
    return Coded(np.concatenate([none, *parts]), np.concatenate([none, *lengths]))


def row_totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.append(0, np.cumsum(values))
    return total[bounds[1:]] - total[bounds[:-1]]


def spaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before each."""
    return np.insert(buf, offsets[:-1], 0x20), offsets + np.arange(len(offsets))
