"""Tables that count as present only once they were written completely.

Every attempt to write a table gets a folder of its own and, after it, a receipt of its own: row count, number, bytes
and digest of its files, and the fingerprint of the inputs it was made from. Names and sizes of the files are kept
beside it. Receipts are never overwritten, so writers do not disturb one another: of several complete attempts from the same
inputs the one that started first wins, and all readers take it. Files are listed by Spark and compared by their
digest, so neither the table is counted nor its file list brought to the driver.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECEIPT_SCHEMA = (
    "attempt STRING, started DOUBLE, request STRING, inputs STRING, folder STRING, rows BIGINT, "
    "files BIGINT, bytes BIGINT, digest STRING"
)

#: Seconds after which folders that no reader takes any more may be removed; frames on them are readable until then.
KEPT_SECONDS = 7 * 24 * 3600.0


class InputsChanged(RuntimeError):
    """An input was replaced while a table was made from it."""


def _beside(path: str, kind: str) -> str:
    return f"{path.rstrip('/')}.{kind}"


def _receipts_path(path: str, request: str) -> str:
    return f"{_beside(path, 'receipts')}/{hashlib.sha256(request.encode()).hexdigest()[:16]}"


def _if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def listed(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, length, modificationTime) of the files at or below ``path``, which may be a pattern; None if there are none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = _if_present(lambda: reader.load(path))
    return None if found is None else found.select("path", "length", "modificationTime")


def _digest(files: DataFrame | None, *columns: str) -> tuple[int, int, str]:
    if files is None:
        return 0, 0, "0"
    one = F.xxhash64(*columns).cast("decimal(38,0)")
    total = files.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(one), F.lit(0)).alias("sum")
    ).first()
    return total["n"], total["bytes"], str(total["sum"])


def fingerprint(spark: SparkSession, inputs: Sequence[str]) -> str:
    """Names, sizes and times of the files of each input in short; it changes when a file is replaced, added or lost."""
    seen = [_digest(listed(spark, path), "path", "length", "modificationTime") for path in inputs]
    return json.dumps([[path, *of] for path, of in zip(inputs, seen, strict=True)])


def _receipts(spark: SparkSession, path: str, request: str | None = None) -> list[Row]:
    """Receipts in the order in which their attempts started, one row for each attempt."""
    where = _beside(path, "receipts") if request is None else _receipts_path(path, request)
    reader = spark.read.schema(RECEIPT_SCHEMA).option("recursiveFileLookup", True)
    found = _if_present(lambda: reader.parquet(where))
    return sorted(found.collect(), key=lambda r: (r["started"], r["attempt"])) if found is not None else []


def _whole(spark: SparkSession, receipt: Row) -> bool:
    files = listed(spark, receipt["folder"])
    return _digest(files, "path", "length") == (receipt["files"], receipt["bytes"], receipt["digest"])


def _winner(spark: SparkSession, receipts: list[Row], inputs: str | None = None) -> Row | None:
    """The first whole attempt from these inputs; without them, from those of the latest whole attempt."""
    if inputs is None:
        latest = next((r for r in reversed(receipts) if _whole(spark, r)), None)
        if latest is None:
            return None
        inputs = latest["inputs"]
    return next((r for r in receipts if r["inputs"] == inputs and _whole(spark, r)), None)


def rows_published(spark: SparkSession, path: str, request: str = "") -> int | None:
    """Row count of the finished table of ``request`` at ``path``, or None if there is none."""
    receipt = _winner(spark, _receipts(spark, path, request))
    return receipt["rows"] if receipt else None


def published_requests(
    spark: SparkSession, path: str, which: Callable[[str], bool] = lambda request: True
) -> dict[str, str]:
    """The folder readers take for each chosen request that has a whole table at ``path``."""
    receipts = [r for r in _receipts(spark, path) if which(r["request"])]
    of = {r["request"]: [x for x in receipts if x["request"] == r["request"]] for r in receipts}
    won = {request: _winner(spark, mine) for request, mine in of.items()}
    return {request: receipt["folder"] for request, receipt in won.items() if receipt}


def lost_files(spark: SparkSession, path: str, request: str = "") -> DataFrame:
    """(attempt, path, length) of files that attempts at ``request`` wrote and that are gone or have another size."""
    schema = "attempt STRING, path STRING, length BIGINT"
    attempts = {r["attempt"]: r["folder"] for r in _receipts(spark, path, request)}
    wrote = _if_present(lambda: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(_beside(path, "files")))
    if wrote is None or not attempts:
        return spark.createDataFrame([], schema)
    wrote = wrote.where(F.col("attempt").isin(list(attempts)))
    there = listed(spark, path)
    return wrote if there is None else wrote.join(there, ["path", "length"], "left_anti").select("attempt", "path", "length")


def publish_if_absent(
    spark: SparkSession,
    path: str,
    schema: StructType,
    write: Callable[[str], None],
    request: str = "",
    inputs: Sequence[str] = (),
) -> DataFrame:
    """The Parquet table of ``request`` below ``path``; ``write(folder)`` makes it if it is not there.

    ``request`` says what the table holds, ``inputs`` names the files it is made from. A table left behind
    by an interrupted writer, one that has lost files since, and one whose inputs were replaced are made again. Inputs
    that change during the write leave no receipt. Every writer gets a fresh folder, so frames on an
    older table stay readable until ``remove_unused`` takes it.
    """
    reader = spark.read.schema(schema)
    now = fingerprint(spark, inputs)
    found = _winner(spark, _receipts(spark, path, request), now)
    if found:
        return reader.parquet(found["folder"])
    started, attempt = time.time(), uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/{attempt}"
    write(folder)
    if inputs and fingerprint(spark, inputs) != now:
        raise InputsChanged(f"{list(inputs)} changed while {folder} was written")
    files = listed(spark, folder)
    if files is not None:
        files.select(F.lit(attempt).alias("attempt"), "path", "length").write.parquet(f"{_beside(path, 'files')}/{attempt}")
    entry = (attempt, started, request, now, folder, reader.parquet(folder).count(), *_digest(files, "path", "length"))
    receipt = spark.createDataFrame([entry], RECEIPT_SCHEMA).coalesce(1)
    receipt.write.parquet(f"{_receipts_path(path, request)}/{attempt}")
    # another writer may have started earlier and finished meanwhile
    return reader.parquet(_winner(spark, _receipts(spark, path, request), now)["folder"])


def remove_unused(spark: SparkSession, path: str, older_than: float = KEPT_SECONDS) -> list[str]:
    """Remove attempts below ``path`` that no reader takes any more and that are older than ``older_than`` seconds.

    Kept are the winner of each request and everything younger, so running writers and frames opened lately are safe as long as
    no write takes longer than that. The receipt goes first: a table is never listed without its files. Returns the removed names.
    """
    receipts = _receipts(spark, path)
    used = {folder.rsplit("/", 1)[1] for folder in published_requests(spark, path).values()}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    before = (time.time() - older_than) * 1000
    removed = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name in used or not status.isDirectory() or status.getModificationTime() >= before:
            continue
        of = [f"{_receipts_path(path, r['request'])}/{name}" for r in receipts if r["attempt"] == name]
        for gone in (*of, f"{_beside(path, 'files')}/{name}", status.getPath().toString()):
            files.delete(jvm.org.apache.hadoop.fs.Path(gone), True)
        removed.append(name)
    return sorted(removed)
