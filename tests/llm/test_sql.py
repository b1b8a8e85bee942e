"""Queries against their SQL, and the pipeline's stages against each other."""

import duckdb
import pytest

import corpus_pipeline
from loomspan.llm import registry


def same(df, sql, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cols = sorted(df.columns)
    want = sorted(map(repr, con.sql(sql).df()[cols].astype(object).itertuples(index=False, name=None)))
    got = sorted(map(repr, df.toPandas()[cols].astype(object).itertuples(index=False, name=None)))
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert 0.8 * docs.count() < len(left) <= docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == left
