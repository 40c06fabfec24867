"""Operator 1: quality score of documents by a kernel classifier on text statistics.

Each whole text becomes ``FEATURES`` numbers (shares of byte classes, word shapes,
repeated words, word pairs and lines, sizes). Standardised by mean and deviation over
all documents, they pass through random Fourier features, which approximate a
Gaussian kernel. Tasks add up the normal equations of the labelled rows, in blocks of
fixed size; the driver solves one ridge system. Labelled rows kept out of the fit
calibrate the raw score by isotonic regression over a fixed number of bins.

Null text counts as empty and gets a score too, as any other. Labels may be missing, null
or repeated (the largest counts). Without labelled rows of both classes every score is
the share of good labels, or 0.5 without any. Rows may repeat; each gets its own score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navette.llm.common import SMALL_SLICE_BYTES, ByteHash, as_blocks, lowered, mix, slices, summed, utf8, words, written

N_FEATURES = 22
#: Random Fourier features; with the constant, the side of the ridge system.
WIDTH = 256
RIDGE = 1e-3
BINS = 1000

_CLASS = np.full(256, 7, np.uint8)  # other ASCII
for _first, _last, _kind in ((97, 122, 0), (65, 90, 1), (48, 57, 2), (128, 255, 3)):
    _CLASS[_first : _last + 1] = _kind
for _chars, _kind in ((b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:'\"-()?", 6)):
    _CLASS[list(_chars)] = _kind


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeated(owner: np.ndarray, values: np.ndarray, n_rows: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per row: share of values that repeat an earlier one, and share of the most frequent value."""
    if not len(values):
        return np.zeros(n_rows), np.zeros(n_rows)
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    total = np.bincount(owner, minlength=n_rows)
    distinct = np.bincount(o[new], minlength=n_rows)
    runs = np.diff(np.append(np.flatnonzero(new), len(v)))
    most = np.zeros(n_rows, np.int64)
    np.maximum.at(most, o[new], runs)
    return _ratio(total - distinct, total), _ratio(most, total)


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of ``N_FEATURES`` statistics of the texts."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = _CLASS[buf]
    owner_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    counts = np.zeros((8, n), np.int64)
    filled = np.flatnonzero(size)
    for kind in range(8):
        if len(filled):
            sums = np.concatenate([[0], np.cumsum(kinds == kind)])
            counts[kind] = sums[offsets[1:]] - sums[offsets[:-1]]
    lower, upper, digit, wide, space, line, mark, odd = counts
    row, start, stop = words(buf, offsets)
    n_words = np.bincount(row, minlength=n)
    length = stop - start
    hashes = ByteHash(lowered(buf)).spans(start, stop) if len(start) else np.zeros(0, np.uint64)
    mean = _ratio(np.bincount(row, length, n), n_words)
    deviation = np.sqrt(np.maximum(_ratio(np.bincount(row, length.astype(float) ** 2, n), n_words) - mean**2, 0))
    again, most = _repeated(row, hashes, n)
    pair = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    pairs = mix(hashes[:-1] + mix(hashes[1:]))[pair] if len(row) > 1 else np.zeros(0, np.uint64)
    pair_again, pair_most = _repeated(row[:-1][pair] if len(row) > 1 else row, pairs, n)
    first = kinds[start] if len(start) else np.zeros(0, np.uint8)
    last = kinds[stop - 1] if len(start) else np.zeros(0, np.uint8)
    ends_odd = np.bincount(row[last == 7], minlength=n)
    starts_upper = np.bincount(row[first == 1], minlength=n)
    alone = np.bincount(row[(length == 1) & (first == 7)], minlength=n)
    breaks = np.flatnonzero(buf == 10)
    edges = np.unique(np.concatenate([offsets[:-1][filled], breaks + 1, offsets[1:][filled]]))
    edges = edges[edges <= len(buf)]
    line_owner = owner_of(edges[:-1]) if len(edges) > 1 else np.zeros(0, np.int64)
    if len(edges) > 1:
        line_again, line_most = _repeated(line_owner, ByteHash(buf).spans(edges[:-1], edges[1:]), n)
    else:
        line_again, line_most = np.zeros(n), np.zeros(n)
    letters = lower + upper + wide
    return np.column_stack(
        [
            np.log1p(size), np.log1p(n_words), mean, deviation, _ratio(lower, size), _ratio(upper, letters),
            _ratio(digit, size), _ratio(wide, size), _ratio(space, size), _ratio(line, size), _ratio(mark, size),
            _ratio(odd, size), again, most, pair_again, pair_most, line_again, line_most,
            _ratio(ends_odd, n_words), _ratio(starts_upper, n_words), _ratio(alone, n_words),
            np.log1p(_ratio(size, line + 1)),
        ]
    )


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats) of all documents; stats holds doubles."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            rows = statistics(*utf8(batch.column("text")))
            stats = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], ["doc_id", "stats"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


@dataclass
class QualityModel:
    """Standardisation, ridge weights and calibration knots; a few hundred kilobytes at any input size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) * self.scale)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(stats))
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel whose width fits standardised columns, and a constant."""
    rng = np.random.default_rng(11)
    w = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], WIDTH - 1))
    b = rng.uniform(0, 2 * np.pi, WIDTH - 1)
    return np.column_stack([np.cos(np.clip(x, -8, 8) @ w + b) * np.sqrt(2 / (WIDTH - 1)), np.ones(len(x))])


def isotonic(good: np.ndarray, total: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: places and non-decreasing levels."""
    blocks: list[list[float]] = []
    for g, t, x in zip(good, total, at, strict=True):
        blocks.append([g, t, x * t])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    places = np.array([b[2] / b[1] for b in blocks])
    # half a row of each class keeps levels inside (0, 1)
    return places, np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])


def fit(stats: DataFrame, labelled: DataFrame) -> QualityModel:
    """Model from statistics of all documents and (doc_id, label) rows."""
    sums = stats.mapInArrow(_moments, "block int, part binary")
    moments = summed(sums, "float64")
    if moments is None or moments[0] == 0:
        moments = np.concatenate([[1.0], np.zeros(2 * N_FEATURES)])
    mean = moments[1 : 1 + N_FEATURES] / moments[0]
    variance = np.maximum(moments[1 + N_FEATURES : 1 + 2 * N_FEATURES] / moments[0] - mean**2, 0)
    scale = np.where(variance > 1e-12, 1 / np.sqrt(np.maximum(variance, 1e-12)), 0.0)
    labels = labelled.where("label is not null").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    # one labelled row in five calibrates
    part = F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    rows = written(stats.join(labels, "doc_id").select("label", "stats", part.alias("calibrates")), "quality-labelled")

    def equations(batches):
        square = np.zeros((WIDTH, WIDTH + 1))
        for batch in batches:
            if batch.num_rows:
                x = fourier((_matrix(batch.column("stats")) - mean) * scale)
                y = batch.column("label").to_numpy()
                square += x.T @ np.column_stack([x, y])
        yield as_blocks(square.ravel())

    fitted = summed(rows.where("not calibrates").select("label", "stats").mapInArrow(equations, "block int, part binary"), "float64")
    system = np.zeros((WIDTH, WIDTH + 1)) if fitted is None else fitted.reshape(WIDTH, WIDTH + 1)
    count, good = system[-1, -2], system[-1, -1]
    share = 0.5 if count == 0 else good / count
    flat = QualityModel(mean, scale, None, np.array([0.0]), np.array([share]))
    if not 0 < good < count:
        return flat
    ridge = np.eye(WIDTH) * RIDGE * count / WIDTH
    ridge[-1, -1] = 0
    model = QualityModel(mean, scale, np.linalg.solve(system[:, :-1] + ridge, system[:, -1]), flat.knots, flat.levels)

    def binned(batches):
        table = np.zeros((BINS, 2))
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch.column("stats")))
                at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
                table[:, 0] += np.bincount(at, batch.column("label").to_numpy(), BINS)
                table[:, 1] += np.bincount(at, minlength=BINS)
        yield as_blocks(table.ravel())

    bins = summed(rows.where("calibrates").select("label", "stats").mapInArrow(binned, "block int, part binary"), "float64")
    table = np.zeros((BINS, 2)) if bins is None else bins.reshape(BINS, 2)
    used = table[:, 1] > 0
    if used.sum() < 2:  # too few to calibrate: the raw score, which aims at 0 and 1
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    places = (np.flatnonzero(used) + 0.5) / BINS * 2 - 0.5
    model.knots, model.levels = isotonic(table[used, 0], table[used, 1], places)
    return model


def _moments(batches):
    total = np.zeros(1 + 2 * N_FEATURES)
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("stats"))
            total += np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])
    yield as_blocks(total)


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) from statistics."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch.column("stats")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def quality_score(model: QualityModel, text: Column) -> Column:
    """The score of a text column."""

    # on Arrow columns: a series would hold each text as an object once more
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        for piece in slices([batch], most=SMALL_SLICE_BYTES):
            out.append(model.score(statistics(*utf8(piece.column("text")))))
        return pa.array(np.concatenate(out))

    return score(text.cast("string"))


def train(docs: DataFrame, labelled: DataFrame) -> tuple[QualityModel, DataFrame]:
    """Model and statistics of all documents; ``labelled`` has doc_id and label (1: good)."""
    stats = written(document_statistics(docs), "quality-stats")
    return fit(stats, labelled), stats
