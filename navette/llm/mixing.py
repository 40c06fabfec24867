"""Operator 7: a mix of sources with target sizes, by systematic sampling.

Every document of a source has the same expected number of copies, target divided by
size of the source. Documents of a source stand in one order; expected copies are
added up along it from one offset of the source, and a document is taken once for each
whole number its step crosses. The order goes by size class, then by a hash of the key, so
the words taken come near the target.

Only DataFrame operations are used. Places in the order come from three levels of
counts (size classes of a source, hash buckets of a class, documents of a bucket), so
the largest source is spread over many tasks and a window holds at most ``BUCKETS`` counts or
the documents of one bucket.

Null text has size 0; a source without words takes nothing. A null source is a source of its
own, the last. Repeated rows are separate documents; which of equal rows is taken
does not matter. Extra columns are not read. An empty table gives an empty mix.
The table of sources (one row each) is numbered in one task; other steps are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navette.llm.common import WORD_BYTES, null_safe_join, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Hash buckets of a size class; four hexadecimal digits.
BUCKETS = 65_536


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_BYTES)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): sizes shared out by weight, nobody above ``most`` times its size.

    The rate per weight rises until the uncapped sources use up what the capped ones
    leave; a pass adds up the sources, of which there are few passes and three numbers each.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (number % len(weights) + 1).cast("int"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(sources.select("source", "source_size", weight.cast("double").alias("weight")), "mix-sources")
    total, rate = None, 0.0
    while True:
        capped = F.col("source_size") * most <= F.col("weight") * rate
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, F.col("source_size") * most)).alias("capped"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
        ).first()
        total = (row.total or 0) * share
        if not row.weight:
            break
        next_rate = (total - (row.capped or 0)) / row.weight
        if next_rate <= rate:
            break
        rate = next_rate
    target = F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(rate))
    return sources.select("source", "source_size", target.alias("target"))


def mix_copies(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """Per document: key, size, source, source_size, target and copies."""
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    sized = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        size_in_words(F.col(text).cast("string")).alias("size"),
        F.coalesce(digest, F.lit("")).alias("digest"),
    )
    bits = F.bin("size")
    sized = written(sized.select("*", F.format_string("%02d%s", F.length(bits), F.substring(bits, 1, 4)).alias("class")), "mix-sizes")
    goal = targets(sized, weights, share, most)

    bucket = F.substring("digest", 1, 4)
    counts = written(sized.groupBy("source", "class", bucket.alias("bucket")).agg(F.count("*").alias("n")), "mix-counts")
    before = lambda frame, order, *by: F.sum("n").over(
        Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"))
    classes = classes.withColumn("class_start", F.coalesce(before(classes, "class", "source"), F.lit(0)))
    buckets = counts.withColumn("bucket_start", F.coalesce(before(counts, "bucket", "source", "class"), F.lit(0)))
    begins = null_safe_join(buckets, classes.drop("n"), ["source", "class"])
    begins = begins.select("source", "class", "bucket", (F.col("class_start") + F.col("bucket_start")).alias("start"))
    offset = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    goal = goal.withColumn("offset", offset)
    place = F.row_number().over(Window.partitionBy("source", "class", bucket).orderBy("digest", "doc_id", "size"))
    placed = sized.withColumn("place", place).withColumn("bucket", bucket)
    placed = null_safe_join(placed, begins, ["source", "class", "bucket"])
    placed = placed.select("doc_id", "size", "source", (F.col("start") + F.col("place")).alias("rank"))
    placed = null_safe_join(placed, goal, ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(rate * rank + F.col("offset"))
    copies = F.least(upto(F.col("rank")) - upto(F.col("rank") - 1), F.lit(most)).cast("long")
    return placed.select(
        F.col("doc_id").alias(key), "size", F.col("source").alias(source), "source_size", "target", copies.alias("copies")
    )


def _free_names(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of the frame."""
    taken = {c.lower() for c in frame.columns}
    return [next(n for n in ("_" * i + name for i in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **settings) -> DataFrame:
    """The documents of the mix, as often as they are taken; columns of ``docs`` and ``copy`` (from 1).

    Rows that share a key take what the mix grants that key, shared out among them. Where ``docs`` has a
    column ``copy``, it stays and the number of the copy is the last column, under the first free of ``_copy``, ``__copy``, ...
    """
    taken = mix_copies(docs, key, source, text, **settings)
    own, copies, n, mine, at, number = _free_names(docs, "__key", "__copies", "__rows", "__mine", "__at", "copy")
    per_key = taken.groupBy(F.col(key).alias(own)).agg(F.sum("copies").alias(copies), F.count("*").alias(n))
    rows = docs.join(per_key, docs[key].eqNullSafe(F.col(own)))
    several = Window.partitionBy(own).orderBy(F.xxhash64(F.col(text)))
    single = rows.where(F.col(n) == 1).withColumn(mine, F.col(copies))
    shared = rows.where(F.col(n) > 1).withColumn(at, F.row_number().over(several))
    upto = lambda place: F.floor(F.col(copies) * place / F.col(n))
    shared = shared.withColumn(mine, upto(F.col(at)) - upto(F.col(at) - 1)).drop(at)
    rows = single.unionByName(shared).where(F.col(mine) > 0)
    rows = rows.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(mine).cast("int"))))
    return rows.select(*docs.columns, number)
