"""Stages on a small fixture against plain versions, and the registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from faultline.llm import queries

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, FOLDER)
        if name != "packing":
            assert out.columns == docs.columns
            assert 0.5 * kept.count() < out.count() < kept.count() or name == "language"
            kept = out
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    pieces = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in pieces} == ids
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)
    classes = queries.jaccard.similarity_classes(kept)
    assert classes.filter("n_links > 0").count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    frame = entry.queries()[name](spark, FOLDER).select(*columns)
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, cursor.fetchall()))
