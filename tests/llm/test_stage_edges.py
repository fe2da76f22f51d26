"""Pipeline stages on nulls, ties, repeated rows, long texts and columns with clashing names."""

import pytest
import test_edges as E

import corpus_pipeline as P
from ebbflow.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __n long, __p string, __w string, __gone long, __id long, __k1 long, rep long, rate double, bucket int, hub long, k int"


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, tmp_path, stage):
    rows = [(*r[:5], 1, "p", None, 7, 8, 9, None, 0.5, 3, 4, 5) for r in E.ROWS]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(E.LABELS, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    name, run = P.STAGES[stage]
    out = run(spark, docs, str(tmp_path))
    found = written(out, "stage").collect()
    if stage < 4:
        assert out.columns == docs.columns and all(r["__p"] == "p" and r.k == 5 for r in found), name
    counts = {k: sum(r.doc_id == k for r in found) for k in {r[0] for r in E.ROWS}}
    if stage == 0:
        assert counts == {1: 2, 2: 1, None: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, -3: 0}  # 7 and -3 repeat themselves
    if stage == 1:
        assert counts == {1: 1, 2: 1, None: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1, 8: 1, -3: 1}
    if stage == 2:
        assert counts == {1: 2, 2: 0, None: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, -3: 1}
    if stage == 4:
        assert sum(r.length for r in found if r.start == 0 and r.doc_id in (3, 4)) == 2
