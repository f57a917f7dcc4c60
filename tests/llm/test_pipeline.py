import os

import pytest

import corpus_pipeline
from taxoweave.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_work_on_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert 0.5 * before < docs.count() <= before, name
            before = docs.count()
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and set(oracle_sql()) <= set(queries())
