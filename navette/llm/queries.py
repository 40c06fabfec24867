"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navette.llm import (
    alignment,
    centroid_clusters,
    chat_format,
    decontaminate,
    embedding_dedup,
    mixing,
    ngram_join,
    personal_data,
    quality,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from navette.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aside = held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").where(~aside).select("doc_id", F.col("quality").alias("label"))
    model, stats = quality.train(docs, labels)
    return quality.scored(stats, model).select(
        "doc_id", aside.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    saying = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", saying), (-7, 1, "assistant", saying)], turns.schema)
    return chat_format.read_back(chat_format.formatted_chats(turns.union(more)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Rules of hosts and paths.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of a path names the document of the page, which may carry a quality label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, path = url_filter.host_and_path(F.col("url"))
    named = pages.select("page_id", F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    judged = url_filter.verdicts(pages, named.join(labels, "doc_id").select("page_id", "label"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aside = held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").where(~aside).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.toxicity(docs, labels).select(
        "doc_id", aside.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.found_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_account"
    )


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = centroid_clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))
    texts = [",".join(map(str, row)) for row in centroids.tolist()]
    digests = [(n, hashlib.sha256(t.encode()).hexdigest()) for n, t in enumerate(texts)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), path)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.aligned_tokens(table(spark, sf_dir, "documents"), *paths, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_mix": op7_mix,
    "op8_ngram_join": op8_ngram_join,
    "op9_decontamination": op9_decontamination,
    "op10_personal_data": op10_personal_data,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_token_counts": op12_token_counts,
    "op13_token_alignment": op13_token_alignment,
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE = {
    "op7_mix": f"""
WITH sized AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), '') AS digest FROM documents
), ordered AS (
  SELECT *, format('{{:02d}}', length(bin(size))) || substr(bin(size), 1, 4) AS class FROM sized
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM totals
), tried AS (
  SELECT *, 2 * source_size / weight AS ratio,
    (1.5 * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(weight) OVER (ORDER BY 2 * source_size / weight DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate
  FROM weighted
), level AS (
  SELECT coalesce((SELECT rate FROM tried WHERE rate <= ratio ORDER BY ratio, source LIMIT 1), 1e300) AS rate
), goals AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * (SELECT rate FROM level)) AS target,
    ('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM weighted
), placed AS (
  SELECT o.doc_id, o.size, g.source_size, g.target, g.start,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY o.source ORDER BY class, digest, o.doc_id, o.size) AS place
  FROM ordered o JOIN goals g ON o.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (least(floor(rate * place + start) - floor(rate * (place - 1) + start), 2) * size)::BIGINT AS taken
FROM placed
""",
}


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds written one after the other, components as rows."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT rid, c, d FROM (
    SELECT x.rid, m.c, sum((x.v - m.v) * (x.v - m.v))::BIGINT AS d FROM parts x JOIN m{n} m USING (i) GROUP BY ALL
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
)""")
        if n < rounds:
            steps.append(f"""s{n} AS (
  SELECT c, i, sum(v)::BIGINT AS s, count(*) AS n FROM a{n} JOIN parts USING (rid) GROUP BY ALL
), m{n + 1} AS MATERIALIZED (
  SELECT c, i, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n + n) % n)) // n END AS v FROM m{n} LEFT JOIN s{n} USING (c, i)
)""")
    return f"""
WITH numbered AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
), kept AS (
  SELECT * FROM numbered WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), places AS (
  SELECT *, unnest(range(1, 65)) AS i FROM kept
), parts AS MATERIALIZED (
  SELECT rid, i, floor(256 * embedding[i]::DOUBLE)::BIGINT AS v FROM places
), drawn AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}
), m0 AS MATERIALIZED (
  SELECT c, i, v FROM drawn JOIN parts USING (rid)
), {", ".join(steps)}, digests AS (
  SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c
)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN digests USING (c)
"""


ORACLE["op11_centroid_clusters"] = _cluster_sql()
