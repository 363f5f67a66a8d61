"""The pipeline is its stages, each on all that the one before kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or ids <= before
        before = ids
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == before
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == kept[r.doc_id] and (r.round_trip or "▁" in r.text) for r in out)
