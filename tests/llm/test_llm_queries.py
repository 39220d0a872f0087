"""Queries of the folder against their SQL, and the shape of the pipeline."""

import pytest

import corpus_pipeline
from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, against, name):
    against(spark, queries.QUERIES[name], queries.SQL[name])


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen, left = docs, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, "/root/testdata/sf0.001").cache()
        now = {r[0] for r in out.select("doc_id").collect()}
        assert now <= left and len(now) == out.count() > 100, name
        if name != "tokens":
            assert out.columns == docs.columns
        seen, left = out, now
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, seen.collect()))
