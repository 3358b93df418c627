"""The corpus pipeline on the smallest tables."""

import corpus_pipeline
from tabsmith.llm.common import scratch, table

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch(spark, f"test-stage-{k}")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        found = [r.doc_id for r in out.select("doc_id").collect()]
        assert found and set(found) <= ids
        if k < 4:
            assert out.columns == columns
        if k in (1, 2):
            assert len(set(found)) == len(found)
        docs, ids = out, set(found)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
