"""Flow files inside zip archives, read in two steps.

Zip does not split, so one task inflates an archive. It does so as a stream and cuts each member into pieces
that end where a record ends; the pieces are dealt over the cluster and written to the shared folder. Then many
tasks parse the pieces, whatever the number of archives. A lost executor costs pieces, not archives.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator, Mapping
from typing import BinaryIO

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession

from navette.schemas import FLOW_FILE_COLUMNS, FLOW_FILE_TYPES
from navette.sources.delimited import MISSING, typed
from navette.sources.shared import fresh_path

#: Unpacked bytes of a piece; a longer record is a piece of its own.
PIECE_BYTES = 8 << 20
PIECE_SCHEMA = "path STRING, member STRING, piece INT, header BINARY, body BINARY"


def read_zip_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives as rows of path and bytes (each must stay below 2 GB, its members need not)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def record_pieces(stream: BinaryIO, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """The header record, then pieces of about ``most`` bytes that end where a record ends.

    A line feed inside quotes ends no record: before a record's end stands an even number of quotes.
    """
    held, quotes, seen, header = b"", 0, 0, True
    while True:
        block = stream.read(min(most, 1 << 20))
        held += block
        if header:
            end = _first_end(held)
            if end is None and block:
                continue
            end = len(held) if end is None else end
            yield held[:end]
            held, header = held[end:], False
        if not block:
            break
        if len(held) < most:
            continue
        quotes += held.count(b'"', seen)
        seen = len(held)
        end, before = held.rfind(b"\n"), quotes
        before -= held.count(b'"', end + 1)
        while end >= 0 and before % 2:
            earlier = held.rfind(b"\n", 0, end)
            before -= held.count(b'"', earlier + 1, end)
            end = earlier
        if end >= 0:
            yield held[: end + 1]
            held, quotes, seen = held[end + 1 :], 0, 0
    if held:
        yield held


def _first_end(text: bytes) -> int | None:
    end = text.find(b"\n")
    while end >= 0 and text.count(b'"', 0, end) % 2:
        end = text.find(b"\n", end + 1)
    return end + 1 if end >= 0 else None


def member_pieces(archives: DataFrame, member: str, most: int = PIECE_BYTES) -> DataFrame:
    """Pieces of the members whose name matches the pattern, with the header of each."""

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "member", "piece", "header", "body"]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for name in fnmatch.filter(archive.namelist(), member):
                        with archive.open(name) as unpacked:
                            found = record_pieces(unpacked, most)
                            header = next(found)
                            for number, body in enumerate(found):
                                row = [[path], [name], [number], [header], [body]]
                                kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names
                                )

    return archives.select("path", "content").mapInArrow(inflate, PIECE_SCHEMA)


def unpacked_members(archives: DataFrame, member: str, most: int = PIECE_BYTES) -> DataFrame:
    """``member_pieces``, dealt over the cluster, written to the shared folder and read back."""
    spark = archives.sparkSession
    path = fresh_path(spark, "zip-pieces")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    member_pieces(archives, member, most).repartition(tasks, "path", "member", "piece").write.parquet(path)
    return spark.read.schema(PIECE_SCHEMA).parquet(path)


def zip_member_rows(
    archives: DataFrame,
    member: str,
    types: Mapping[str, str],
    sep: str = ";",
    observed: Observation | None = None,
    most: int = PIECE_BYTES,
) -> DataFrame:
    """Rows of the delimited members whose name matches the pattern ``member``.

    Columns are found by the name in each member's own header. Cells are trimmed, as in the reader of plain files.
    """
    names = list(types)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for header, body in zip(batch.column("header"), batch.column("body"), strict=True):
                text = header.as_py().rstrip(b"\r\n") + b"\n" + body.as_py()
                yield from pacsv.open_csv(
                    io.BytesIO(text),
                    parse_options=pacsv.ParseOptions(delimiter=sep, newlines_in_values=True),
                    convert_options=pacsv.ConvertOptions(
                        include_columns=names,
                        column_types={n: pa.string() for n in names},
                        null_values=list(MISSING),
                        strings_can_be_null=True,
                    ),
                )

    pieces = unpacked_members(archives, member, most).select("header", "body")
    text = pieces.mapInArrow(parse, ", ".join(f"`{n}` STRING" for n in names))
    return typed(text, types, True, observed)


def read_flux_zip(
    archives: DataFrame, member: str, sep: str = ";", observed: Observation | None = None, most: int = PIECE_BYTES
) -> DataFrame:
    """The four flow columns of the named member of every archive."""
    rows = zip_member_rows(archives, member, FLOW_FILE_TYPES, sep, observed, most)
    return rows.withColumnsRenamed(FLOW_FILE_COLUMNS)


def write_zip_archives(frame: DataFrame, folder: str, member: str, sep: str = ";") -> int:
    """One archive below ``folder`` for each task of ``frame`` with rows, its rows in ``member``; how many there are.

    A task that runs again replaces its archive.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        target = None
        number = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if target is None:
                store.create_dir(root, recursive=True)
                file = store.open_output_stream(f"{root}/part-{number:05d}.zip")
                packed = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                target = packed.open(member, "w", force_zip64=True)
                rows = pacsv.CSVWriter(target, batch.schema, write_options=pacsv.WriteOptions(delimiter=sep))
            rows.write_batch(batch)
        if target is not None:
            for part in (rows, target, packed, file):
                part.close()
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32())})

    return frame.mapInArrow(pack, "number INT").count()
