"""Operator 6: toxicity of documents after undoing disguises.

A disguised word passed a noisy channel: letters written as digits or signs, letters
set apart by spaces or marks, letters repeated. Words that show such signs become a
lattice of readings, and the Viterbi algorithm finds the likeliest one under a character
trigram model counted over all documents. The channel has costs, negative logarithms of what it
does to a meant letter: showing a sign for it (``SUBSTITUTE``), repeating it once
(``REPEAT``) and once more (``AGAIN``), setting a gap after it (``GAP``) that may also
end a word (``BOUNDARY``); a digit may also be meant as one
(``LITERAL``). A double letter therefore stays where the language has it. A space inside a run of single letters is
read as a gap or as a word boundary, so a run is cut into words. Letters are code points with
the combining marks after them. The restored text is scored by its words and
word beginnings: how much more often each occurs in toxic than in other labelled
documents, by a lower confidence bound; the three strongest words of a document add up, and
isotonic regression on labelled rows kept out of the fit turns the sum into a probability.

Words and beginnings are told apart by hashes of 64 bits. Labelled documents are counted per
hash by an aggregate with a map-side combine; only features above the bound reach the driver and
the tasks. Trigrams are added up in tables of fixed size. At most ``LABEL_BOUND`` labelled rows
(those with the smallest key hashes) are taken to the tasks.

Null text counts as empty; a text without words has no evidence and gets the score of that.
Labels may be missing, null or repeated (the largest counts); without labelled rows every
score is 0. A null key has no label; keys are integers. Rows may repeat; each gets its own score. Whole texts are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navette.llm.common import ByteHash, as_blocks, lowered, slices, summed, utf8, words, written
from navette.llm.quality import isotonic

#: Labelled rows the model may learn from.
LABEL_BOUND = 200_000
#: Bytes of a word's beginnings that are features of their own.
BEGINNINGS = (4, 6)
#: Standard errors below the estimate that a word's weight is set.
CAUTION = 3.0
#: Smallest weight that counts; words that merely go with toxic text weigh less.
LEAST_WEIGHT = 0.7
STRONGEST = 3
BINS = 1000

SYMBOLS = 28  # boundary, a to z, other letters
# fixed values: what signs may stand for
READINGS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
MARKS = ".-_*"
# costs of the channel in nats, set by hand: in a word that looks disguised, signs and gaps are common, and a letter
# that was drawn out once is often drawn out further
SUBSTITUTE = 1.0
REPEAT = 6.0
AGAIN = 2.0
GAP = 0.1
BOUNDARY = 1.0
LITERAL = 6.0

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27
_LETTER = _SYMBOL > 0
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in READINGS]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in MARKS]] = True
_CORE = _LETTER.copy()
_CORE[48:58] = True
_APART = re.compile(r"^(?:[^\s.\-_*][\u0300-\u036f]*[.\-_*]+){2,}[^\s.\-_*][\u0300-\u036f]*$")


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol triples over all documents."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches):
            buf, offsets = utf8(batch.column("text"))
            # one symbol for each code point
            first = (buf & 0xC0) != 0x80
            offsets = np.concatenate([[0], np.cumsum(first)])[offsets]
            buf = buf[first]
            # two boundaries after each document keep triples inside it
            at = np.arange(len(buf)) + 2 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
            codes = np.zeros(len(buf) + 2 * len(offsets), np.int64)
            codes[at] = _SYMBOL[buf]
            total += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
        yield as_blocks(total)

    found = summed(docs.select("text").mapInArrow(run, "block int, part binary"), "int64")
    return np.zeros(SYMBOLS**3, np.int64) if found is None else found


@dataclass
class Restorer:
    """Undoes disguises of words; holds log probabilities of symbol triples."""

    costs: np.ndarray
    cache: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, counts: np.ndarray) -> Restorer:
        table = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        return cls(-np.log((table + 0.1) / (table.sum(axis=2, keepdims=True) + 0.1 * SYMBOLS)))

    def word(self, token: str) -> str:
        """Likeliest reading of one disguised word, lower-cased."""
        known = self.cache.get(token)
        if known is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            known = self.cache[token] = self._decode(token.lower())
        return known

    def _decode(self, token: str) -> str:
        # state: the last two symbols, the last letter read and whether it was repeated;
        # value: cost and the reading so far as a linked list
        start = (0, 0, "", False)
        states: dict[tuple, tuple[float, tuple | None]] = {start: (0.0, None)}
        for seen in token:
            reached: dict[tuple, tuple[float, tuple | None]] = {}
            for (p, q, last, again), (cost, path) in states.items():
                for state, price, read in self._steps(seen, p, q, last, again):
                    total = cost + price
                    if state not in reached or total < reached[state][0]:
                        reached[state] = total, (read, path) if read else path
            states = reached
        _, path = min(((cost + self.costs[p, q, 0], way) for (p, q, _, _), (cost, way) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def _steps(self, seen: str, p: int, q: int, last: str, again: bool):
        """What a seen sign may mean: next state, cost, and the letter it adds."""
        boundary = self.costs[p, q, 0]
        if seen == " " or seen in MARKS:
            yield (p, q, last, again), GAP, ""
            if seen == " ":
                yield (q, 0, "", False), BOUNDARY + boundary, " "
            return
        meant = READINGS.get(seen)
        for letter in meant or seen:
            symbol = _symbol(letter)
            channel = SUBSTITUTE if meant else 0.0
            yield (q, symbol, letter, False), channel + self.costs[p, q, symbol], letter
            if letter == last:
                yield (p, q, last, True), AGAIN if again else REPEAT, ""
        if meant and seen.isdigit():
            yield (q, 0, "", False), LITERAL + boundary, seen

    def rows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows with disguised words restored."""
        row, start, stop = words(buf, offsets)
        if not len(start):
            return buf, offsets
        begin, end, several = disguised(buf, row, start, stop)
        if not len(begin):
            return buf, offsets
        data = buf.tobytes()
        pieces, at, grown = [], 0, np.zeros(len(begin), np.int64)
        for k, (a, b, apart) in enumerate(zip(begin.tolist(), end.tolist(), several.tolist(), strict=True)):
            token = data[a:b].decode("utf-8", "replace")
            if apart:
                token = " ".join(token.split())
            word = self.word(token).encode()
            pieces += [data[at:a], word]
            grown[k] = len(word) - (b - a)
            at = b
        pieces.append(data[at:])
        shift = np.concatenate([[0], np.cumsum(grown)])
        return np.frombuffer(b"".join(pieces), np.uint8), offsets + shift[np.searchsorted(begin, offsets, "left")]

    def text(self, text: str | None) -> str | None:
        """One text, restored."""
        if not text:
            return text
        buf = np.frombuffer(text.encode(), np.uint8)
        return self.rows(buf, np.array([0, len(buf)]))[0].tobytes().decode("utf-8", "replace")


def _symbol(letter: str) -> int:
    code = ord(letter)
    return code - 96 if 97 <= code <= 122 else 27 if code >= 128 else 0


def _last_core(buf: np.ndarray) -> np.ndarray:
    """Per byte the place of the last letter or digit up to it."""
    return np.maximum.accumulate(np.where(_CORE[buf], np.arange(len(buf)), -1))


def _letters(buf: np.ndarray) -> np.ndarray:
    """Whether a letter or other sign begins at each byte: no continuation byte, no combining mark (U+0300 to U+036F)."""
    begins = (buf & 0xC0) != 0x80
    after = np.append(buf[1:], 0)
    begins[(buf == 0xCC) | ((buf == 0xCD) & (after < 0xB0))] = False
    return begins


def disguised(buf, row, start, stop) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of what looks disguised, in order, and whether it is a run of single letters."""
    end = np.maximum(_last_core(buf)[stop - 1] + 1, start)
    count = lambda flags: (lambda s: s[end] - s[start])(np.concatenate([[0], np.cumsum(flags)]))
    letters = count(_LETTER[buf])
    thrice = np.zeros(len(buf), bool)
    if len(buf) > 2:
        thrice[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _LETTER[buf[2:]] & (buf[2:] < 128)
    # the third equal letter must lie inside the word
    drawn = count(thrice) > 0
    signed = (count(_SIGN[buf]) > 0) & (letters > 0)
    marks = count(_MARK[buf])
    begins = np.concatenate([[0], np.cumsum(_letters(buf))])
    apart = np.flatnonzero((marks >= 2) & (letters > 0) & (begins[end] - begins[start] <= 2 * marks + 1))
    marked = np.zeros(len(start), bool)
    for i in apart.tolist():
        marked[i] = _APART.match(buf[start[i] : end[i]].tobytes().decode("utf-8", "replace")) is not None
    flagged = drawn | signed | marked
    single = (begins[stop] - begins[start] == 1) & (_LETTER[buf[start]] | _SIGN[buf[start]])
    # of the signs beyond ASCII only letters count
    for i in np.flatnonzero(single & (stop - start > 1)).tolist():
        single[i] = buf[start[i] : stop[i]].tobytes().decode("utf-8", "replace")[0].isalpha()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    froms, ends, several = [start[flagged]], [end[flagged]], [np.zeros(int(flagged.sum()), bool)]
    first, last = edge[::2], edge[1::2]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= 3:
            cuts = [a, *(np.flatnonzero(np.diff(row[a:b])) + a + 1).tolist(), b]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s >= 3 and _LETTER[buf[start[s:e]]].any():
                    froms.append(start[s : s + 1]), ends.append(stop[e - 1 : e]), several.append(np.ones(1, bool))
    begin, finish, run = (np.concatenate(x) for x in (froms, ends, several))
    order = np.argsort(begin, kind="stable")
    return begin[order], finish[order], run[order]


def word_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number and hash of every feature: whole words and their beginnings, without signs around them."""
    buf = lowered(buf)
    row, start, stop = words(buf, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    core = np.where(_CORE[buf], np.arange(len(buf)), len(buf))
    begin = np.minimum.accumulate(core[::-1])[::-1][start]
    end = _last_core(buf)[stop - 1] + 1
    keep = (begin < stop) & (end > begin)
    row, begin, end = row[keep], begin[keep], end[keep]
    hashes = ByteHash(buf)
    number = np.arange(len(row))
    rows, numbers, features = [row], [number], [hashes.spans(begin, end)]
    for salt, length in enumerate(BEGINNINGS, 1):
        long = end - begin > length
        rows.append(row[long]), numbers.append(number[long])
        features.append(hashes.spans(begin[long], begin[long] + length) + np.uint64(salt))
    return np.concatenate(rows), np.concatenate(numbers), np.concatenate(features)


def label_arrays(labelled: DataFrame, bound: int = LABEL_BOUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, labels and calibration flags of at most ``bound`` labelled rows."""
    labels = labelled.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    part = F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    rows = labels.select("doc_id", F.col("label").cast("int").alias("label"), part.alias("aside"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).toPandas().sort_values("doc_id")
    return rows["doc_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), rows["aside"].to_numpy(bool)


@dataclass
class Weights:
    """Sorted hashes of the features that count, and their weights."""

    features: np.ndarray
    values: np.ndarray

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the features count, and their places."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        found = np.flatnonzero(self.features[place] == features)
        return found, place[found]


def feature_counts(docs: DataFrame, restorer: Restorer, labels: tuple) -> DataFrame:
    """(feature, clean, toxic): labelled documents that hold each feature; feature null: all of them."""
    keys, label, aside = labels

    def run(batches):
        for batch in slices(batches):
            column = batch.column("doc_id")
            ids, named = column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(keys, ids), max(len(keys) - 1, 0))
            known = named & (keys[at] == ids) & ~aside[at] if len(keys) else np.zeros(len(ids), bool)
            if not known.any():
                continue
            toxic = label[at[known]]
            taken = batch.filter(pa.array(known))
            row, _, feature = word_features(*restorer.rows(*utf8(taken.column("text"))))
            distinct, place = np.unique(feature, return_inverse=True)
            width = max(len(distinct), 1)
            pair = np.unique(row * width + place)
            held = np.bincount(toxic[pair // width] * width + pair % width, minlength=2 * width)
            clean, bad = held[: len(distinct)], held[width : width + len(distinct)]
            # the last row counts the documents
            columns = [
                pa.array(np.append(distinct.view(np.int64), 0), mask=np.append(np.zeros(len(distinct), bool), True)),
                pa.array(np.append(clean, np.sum(toxic == 0))), pa.array(np.append(bad, np.sum(toxic == 1))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

    found = docs.mapInArrow(run, "feature long, clean long, toxic long")
    return found.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def word_weights(docs: DataFrame, restorer: Restorer, labels: tuple) -> Weights:
    """Features by the lower bound of the log ratio of their document shares, if it is high enough."""
    counts = written(feature_counts(docs, restorer, labels), "toxicity-features")
    total = counts.where("feature is null").first()
    if total is None:
        return Weights(np.zeros(0, np.uint64), np.zeros(0))
    clean, toxic = F.col("clean") + 1.0, F.col("toxic") + 1.0
    ratio = F.log(toxic / (total.toxic + 2.0)) - F.log(clean / (total.clean + 2.0))
    bound = ratio - CAUTION * F.sqrt(1 / toxic + 1 / clean)
    strong = counts.where("feature is not null").select("feature", bound.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    rows = strong.toPandas()
    features, values = rows["feature"].to_numpy(np.int64).view(np.uint64), rows["weight"].to_numpy(float)
    order = np.argsort(features)
    return Weights(features[order], values[order])


def evidence(buf: np.ndarray, offsets: np.ndarray, weights: Weights) -> np.ndarray:
    """Per row the sum of its strongest distinct words' weights."""
    out = np.zeros(len(offsets) - 1)
    row, number, feature = word_features(buf, offsets)
    strong, place = weights.find(feature)
    row, number, weight = row[strong], number[strong], weights.values[place]
    if not len(row):
        return out
    # a word counts by its strongest feature, and once per document
    order = np.lexsort((-weight, number))
    order = order[np.concatenate([[True], number[order][1:] != number[order][:-1]])]
    row, weight, place = row[order], weight[order], place[order]
    _, once = np.unique(row * len(weights.features) + place, return_index=True)
    row, weight = row[once], weight[once]
    order = np.lexsort((-weight, row))
    row, weight = row[order], weight[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
    first = rank < STRONGEST
    np.add.at(out, row[first], weight[first])
    return out


def document_evidence(docs: DataFrame, restorer: Restorer, weights: Weights) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            found = evidence(*restorer.rows(*utf8(batch.column("text"))), weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "evidence"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, evidence double")


def toxicity(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document; ``labelled`` has doc_id and label (1: toxic)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    restorer = Restorer.of(trigram_counts(docs))
    labels = label_arrays(labelled)
    weights = word_weights(docs, restorer, labels)
    found = written(document_evidence(docs, restorer, weights), "toxicity-evidence")
    most = 3 * 12.0
    aside = pd.DataFrame({"doc_id": labels[0][labels[2]], "label": labels[1][labels[2]]})
    places, levels = np.array([0.0]), np.array([float(labels[1].mean()) if len(labels[1]) else 0.0])
    if len(aside):
        known = docs.sparkSession.createDataFrame(aside, "doc_id long, label long")
        cell = F.least(F.floor(F.col("evidence") / most * BINS), F.lit(BINS - 1)).alias("cell")
        bins = found.join(known, "doc_id").groupBy(cell).agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
        bins = bins.orderBy("cell").toPandas()
        if len(bins):
            at = bins["cell"].to_numpy(float) / BINS * most
            places, levels = isotonic(bins["toxic"].to_numpy(float), bins["n"].to_numpy(float), at)

    @F.pandas_udf("double")
    def calibrated(values: pd.Series) -> pd.Series:
        # above the last place the score keeps rising, so that stronger evidence ranks higher
        more = np.maximum(values.to_numpy() - places[-1], 0)
        base = np.interp(values.to_numpy(), places, levels)
        return pd.Series(base + (1 - base) * more / (more + most))

    return found.select(F.col("doc_id").alias(key), calibrated("evidence").alias("score"))
