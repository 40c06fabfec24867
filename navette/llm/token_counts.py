"""Operator 12: number of tokens of each text.

Texts are cut at safe boundaries (see ``encoding``), the distinct chunks of a slice are encoded in batches balanced
by bytes, and only lengths leave the task: a text's count is the sum over its chunks. No row is shuffled, so a
hot source or a very long text costs the bytes it has.

Null and empty texts have 0 bytes and 0 tokens. Rows may repeat, keys may be null, other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navette.llm.common import slices, utf8
from navette.llm.encoding import SLICE_BYTES, Encoder, Vocabulary, batches_of, chunks_of, row_totals, spaced


def lengths(distinct: pa.Array, encoder: Encoder) -> np.ndarray:
    """Number of tokens of each chunk."""
    parts = [np.zeros(0, np.int64)]
    for texts in batches_of(distinct):
        parts.append(np.fromiter(map(len, encoder.ids(texts)), np.int64, len(texts)))
    return np.concatenate(parts)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_bytes (UTF-8) and n_tokens by the tokenizer at ``path``.

    No token is added at either end; special strings inside texts are handled as the library does by default.
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches):
        encoder = None
        for batch in slices(batches, "__text", SLICE_BYTES):
            encoder = encoder or Encoder(vocabulary.value)
            buf, offsets = utf8(batch.column("__text"))
            size = np.diff(offsets)
            if encoder.adds_space:
                # the space stands for the one the library adds; an empty text has no tokens
                buf, offsets = _spaced_where(buf, offsets, size > 0)
            chunks = chunks_of(buf, offsets, encoder)
            n = row_totals(lengths(chunks.distinct, encoder)[chunks.which], chunks.bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n)], [key, "n_bytes", "n_tokens"])

    name = f"`{key}` {rows.schema[0].dataType.simpleString()}"
    return rows.mapInArrow(run, f"{name}, n_bytes long, n_tokens long")


def _spaced_where(buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, _ = spaced(buf, np.append(offsets[:-1][wanted], offsets[-1]))
    return own, offsets + np.append(0, np.cumsum(wanted))
