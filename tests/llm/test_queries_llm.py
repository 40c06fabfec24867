"""Registered text queries against SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from navette.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    frame = QUERIES[name](spark, DATA).toPandas()
    base = duckdb.connect()
    for table in ("documents", "embeddings"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = base.execute(ORACLE[name]).df()[list(frame.columns)]
    order = list(frame.columns)
    left = frame.sort_values(order).reset_index(drop=True)
    right = want.sort_values(order).reset_index(drop=True).astype(left.dtypes.to_dict())
    assert left.equals(right)


def test_pipeline_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= before and len(kept) > 0.7 * len(before)
        before = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() > 0
