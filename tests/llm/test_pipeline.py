"""The stages over the smallest driver tables."""

import os

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, FOLDER)
        docs = corpus_pipeline.Staged(docs).df
        after = {r.doc_id for r in docs.collect()}
        assert after <= before and after
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.where("NOT round_trip").count() == 0
