"""Unique-key side tables: measured once, then attached without fan-out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Counted per value on top of the text itself.
VALUE_OVERHEAD = 16


class LookupKeyError(ValueError):
    """The side table cannot be attached: its key is missing or repeated."""


@dataclass(frozen=True)
class Lookup:
    """A side table with one row per key and a measured size.

    ``of`` measures with one aggregate. Selections of the table can only shrink
    it, so they inherit the measure. A table within the bound is broadcast; a
    larger one is joined by shuffle, where adaptive execution splits the
    partitions of keys that hold too many rows.
    """

    frame: DataFrame
    key: str
    rows: int
    size_bytes: int

    @classmethod
    def of(cls, frame: DataFrame, key: str) -> Lookup:
        size = F.lit(VALUE_OVERHEAD * len(frame.columns))
        for field in frame.schema.fields:
            if isinstance(field.dataType, T.StringType):
                size = size + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        per_key = frame.groupBy(key).agg(
            F.count("*").alias("n"), F.sum(size).alias("size_bytes")
        )
        found = per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
            F.count_if(F.col("n") > 1).alias("repeated"),
            F.count_if(F.col(key).isNull()).alias("missing"),
            F.min(F.when(F.col("n") > 1, F.col(key))).alias("example"),
        ).first()
        if found["missing"]:
            raise LookupKeyError(f"{key} is NULL in the side table")
        if found["repeated"]:
            raise LookupKeyError(
                f"{found['repeated']} values of {key} occur more than once, "
                f"for example {found['example']}"
            )
        return cls(frame, key, found["rows"], found["size_bytes"])

    @property
    def broadcastable(self) -> bool:
        return self.rows <= MAX_BROADCAST_ROWS and self.size_bytes <= MAX_BROADCAST_BYTES

    def where(self, condition: Column) -> Lookup:
        return replace(self, frame=self.frame.filter(condition))

    def select(self, *columns: str) -> Lookup:
        return replace(self, frame=self.frame.select(*columns))

    def side(self) -> DataFrame:
        """The table as a join side, hinted only when its size allows it."""
        return F.broadcast(self.frame) if self.broadcastable else self.frame

    def attach(
        self,
        facts: DataFrame,
        on: str,
        columns: Mapping[str, str],
        how: str = "left",
    ) -> DataFrame:
        """Join ``columns`` (name here -> name in the result) onto ``facts.on``."""
        key = f"__{self.key}_of_{on}"
        picked = self.frame.select(
            F.col(self.key).alias(key),
            *[F.col(old).alias(new) for old, new in columns.items()],
        )
        side = replace(self, frame=picked, key=key).side()
        return facts.join(side, facts[on] == side[key], how).drop(key)

    def keep_members(self, facts: DataFrame, on: str) -> DataFrame:
        """Rows of ``facts`` whose ``on`` is a key of this table."""
        keys = replace(self, frame=self.frame.select(F.col(self.key).alias("__member"))).side()
        return facts.join(keys, facts[on] == keys["__member"], "left_semi")
