"""The pipeline against its stages' rules, stage by stage."""

import pytest

import corpus_pipeline as P
from ebbflow.llm import exact, mixing, near, quality
from ebbflow.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(P.STAGES):
        after = written(stage(spark, before, sf), f"stage{k}")
        if k < 4:
            assert after.columns == docs.columns, name
            assert after.exceptAll(before).isEmpty(), name
            ids = {r.doc_id for r in after.collect()}
            assert ids, name
        if k == 0:
            assert ids == {r.doc_id for r in quality.judge(before).where("kept").collect()}
        elif k == 1:
            assert ids == {r.doc_id for r in exact.DigestIndex.fresh(spark, 4).assign(before).where("kept").collect()}
        elif k == 2:
            assert ids == {r.doc_id for r in near.near_components(before).where("kept").collect()}
        elif k == 3:
            assert ids == {r.doc_id for r in mixing.mix(before, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
        else:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after


def test_run(spark, sf):
    rows = P.run(spark, sf).collect()
    assert rows and all(r.length > 0 for r in rows) and len(P.STAGES) == 5


@pytest.mark.parametrize("stage", range(5))
def test_empty(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert P.STAGES[stage][1](spark, docs, sf).count() == 0
