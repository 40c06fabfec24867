"""Operator 10: spans of personal data, found by anchors.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, schemes (``://``),
plus signs, digits and cue words of identifiers. At each anchor a deterministic parser
expands left and right and validates. Kinds, in their order:

* ``email``, ``ip``, ``card``, ``phone``: the base kinds, leftmost and non-overlapping per kind;
  a candidate that fails its check is dropped and its text is not tried again.
* ``url``: scheme and everything up to white space, angle brackets or quotes.
* ``account``: an identifier of at least five characters with four digits after a cue word.

Positions are code points, ends exclusive. Null and empty texts have no spans. The time
is linear in the text: parsers continue after the previous span of their kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

# fixed values: characters and shapes of the base kinds
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"://[^\s<>\"']+")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
#: Words that announce an identifier; also tried capitalised and in capitals.
CUES = ("account", "acct", "iban", "ssn", "passport", "customer id", "user id", "konto", "compte", "cuenta")
_AFTER_CUE = re.compile(r"(?:\s?(?:no|nr|number|num)\b)?[\s.:#=-]{1,4}([A-Z]{0,4}[0-9][A-Z0-9]*(?:[ -][A-Z0-9]+)*)(?![A-Za-z])")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "://", "+"):
        found.add_word(mark, (mark, 1))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for cue in CUES:
        for word in (cue, cue.capitalize(), cue.title(), cue.upper()):
            found.add_word(word, ("cue", len(word)))
    found.make_automaton()
    return found


def passes_luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


class SpanFinder:
    def __init__(self):
        self.anchors = _anchors()

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of all spans, sorted."""
        if not text:
            return []
        spans: list[tuple[int, int, int]] = []
        done = [0] * len(KINDS)
        last_digit = -2
        for end, (what, length) in self.anchors.iter(text):
            if what == "digit":
                # a run of digits is tried once, or where an earlier candidate ended inside
                if end != last_digit + 1 or end == done[1]:
                    self._ip(text, end, done, spans)
                if end >= done[2]:
                    self._card(text, end, done, spans)
                last_digit = end
            elif what == "@":
                self._email(text, end, done, spans)
            elif what == "+":
                self._phone(text, end, done, spans)
            elif what == "://":
                self._url(text, end - 2, done, spans)
            else:
                self._account(text, end + 1, length, done, spans)
        spans.sort()
        return spans

    @staticmethod
    def _email(text, at, done, spans):
        start = at
        while start > done[0] and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            spans.append((start, 0, m.end()))
            done[0] = m.end()

    @staticmethod
    def _ip(text, at, done, spans):
        if at >= done[1] and (m := _IP.match(text, at)):
            done[1] = m.end()
            parts = [part.lstrip("0") or "0" for part in m[0].split(".")]
            if all(len(part) <= 3 and int(part) <= 255 for part in parts):
                spans.append((at, 1, m.end()))

    @staticmethod
    def _card(text, at, done, spans):
        if m := _CARD.match(text, at):
            done[2] = m.end()
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and passes_luhn(digits):
                spans.append((at, 2, m.end()))

    @staticmethod
    def _phone(text, at, done, spans):
        if at >= done[3] and (m := _PHONE.match(text, at)):
            done[3] = m.end()
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                spans.append((at, 3, m.end()))

    @staticmethod
    def _url(text, at, done, spans):
        start = at
        while start > done[4] and text[start - 1] in _SCHEME:
            start -= 1
        while start < at and not text[start].isalpha():
            start += 1
        if start < at and at >= done[4] and (m := _URL_REST.match(text, at)):
            stop = m.end()
            while text[stop - 1] in ".,;:!?)":
                stop -= 1
            if stop > at + 3:
                spans.append((start, 4, stop))
                done[4] = stop

    @staticmethod
    def _account(text, at, length, done, spans):
        before = at - length - 1
        if before >= 0 and text[before].isalnum():
            return
        m = _AFTER_CUE.match(text, at)
        if m and m.start(1) >= done[5] and sum(c in "0123456789" for c in m[1]) >= 4 and len(m[1]) >= 5:
            spans.append((m.start(1), 5, m.end(1)))
            done[5] = m.end(1)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def found_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, a count for each kind, base_sha256 and spans (kind:start:end, comma-joined)."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        finder = SpanFinder()
        for batch in batches:
            numbers, digests, texts = [[] for _ in KINDS], [], []
            for value in batch.column("text"):
                spans = finder(value.as_py())
                for k, column in enumerate(numbers):
                    column.append(sum(s[1] == k for s in spans))
                base = joined([s for s in spans if s[1] < len(BASE)])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                texts.append(joined(spans))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in numbers)]
            columns += [pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    found = docs.mapInArrow(run, f"doc_id {id_type}, {counts}, base_sha256 string, spans string")
    return found.withColumnRenamed("doc_id", key)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each personal span as ``[KIND]``; overlapping spans count as the first, longest one.

    A web address alone is not personal: it stays unless it carries a user (``user:word@``).
    """
    if not text:
        return text
    out, at = [], 0
    for start, kind, end in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if KINDS[kind] == "url" and "@" not in text[start:end].split("://", 1)[1].split("/", 1)[0]:
            continue
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


def without_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal spans masked; null stays null."""

    @F.pandas_udf("string")
    def mask(batches: "Iterator[pd.Series]") -> "Iterator[pd.Series]":
        finder = SpanFinder()
        for texts in batches:
            yield pd.Series([masked(t, finder(t)) for t in texts], dtype=object)

    return docs.withColumn(text, mask(F.col(text).cast("string")))
