"""Mixing reaches its targets: expected and drawn totals on whole tables."""

import os

import pytest

from ebbflow.llm import mixing
from ebbflow.llm.common import checkpointed

LARGE = "/root/testdata/sf0.1"
OTHERS = {"thin": mixing.MixConfig(targets=(0.7, 0.2, 0.1), scarce="thin"), "copies": mixing.MixConfig(targets=(0.8, 0.15, 0.05), most_copies=4.0, budget=0.9)}


def shares(rows, often):
    totals = [sum(r.n_tokens * r[f"p_{d}"] * often(r) for r in rows) for d in mixing.DOMAINS]
    return [t / sum(totals) for t in totals]


@pytest.fixture(scope="module")
def rows(spark):
    if not os.path.isdir(LARGE):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    return mixing.mix(docs, labels).collect()


def test_totals_meet_targets(rows):
    cfg = mixing.MixConfig()
    for got in (shares(rows, lambda r: r.rate), shares(rows, lambda r: r.copies)):
        assert got == pytest.approx(list(cfg.targets), rel=0.02), got
    assert all(0 <= r.rate <= cfg.most_copies and r.kept == (r.copies > 0) for r in rows)
    clean = [r for r in rows if r.p_good > 0.95]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)


@pytest.mark.parametrize("name", OTHERS)
def test_other_targets(spark, rows, name):
    cfg = OTHERS[name]
    marks = spark.createDataFrame([(r.doc_id, r.n_tokens, [r.p_good, r.p_poor, r.p_toxic]) for r in rows], "doc_id long, __n long, __p array<double>")
    done, fit = mixing.fit_rates(checkpointed(marks.withColumn("__u", mixing.draw_key(marks["doc_id"], marks["doc_id"].cast("string"), cfg))), cfg)
    whole = sum(fit.drawn)
    assert list(fit.expected) == pytest.approx([w * sum(fit.expected) for w in cfg.targets], rel=0.02)
    assert list(fit.drawn) == pytest.approx([w * whole for w in cfg.targets], rel=0.02) and (cfg.budget is None or whole == pytest.approx(cfg.budget, rel=0.01))
    copies = done.select(fit.copies(done["__rate"], done["__p"], done["__u"], cfg).alias("c")).collect()
    assert 1 <= max(r.c for r in copies) <= cfg.most_copies and min(r.c for r in copies) == 0
    assert cfg.most_copies == 1 or any(r.c > 1 for r in copies)


def test_scarce_domains():
    assert mixing.weights_of([0.9, 0.09, 0.01], mixing.MixConfig(targets=(0.5, 0.3, 0.2))) == pytest.approx([0.9, 0.09, 0.01])
    assert mixing.weights_of([0.9, 0.09, 0.01], mixing.MixConfig(targets=(0.5, 0.3, 0.2), scarce="thin")) == [0.5, 0.3, 0.2]
    kept = mixing.weights_of([0.8, 0.19, 0.01], mixing.MixConfig(targets=(0.9, 0.05, 0.05)))
    assert kept[0] / kept[1] == pytest.approx(18) and kept[2] / kept[0] == pytest.approx(0.01 / 0.8)


@pytest.mark.parametrize("n", [1, 3, 12])
def test_few_documents_are_not_all_lost(spark, n):
    rows = [(k, 100, [0.9, 0.05, 0.05] if k % 3 else [0.2, 0.5, 0.3], (k * 0.37) % 1.0) for k in range(n)]
    done, fit = mixing.fit_rates(spark.createDataFrame(rows, "doc_id long, __n long, __p array<double>, __u double"))
    copies = [r.c for r in done.select(fit.copies(done["__rate"], done["__p"], done["__u"], mixing.MixConfig()).alias("c")).collect()]
    assert sum(copies) >= n // 2


def test_clean_documents_stay_where_targets_cannot_be_met(spark):
    rows = [(k, 100 + k % 7, [0.95, 0.045, 0.005] if k % 10 else [0.1, 0.8, 0.1], (k * 0.6180339) % 1.0) for k in range(2000)]
    done, fit = mixing.fit_rates(spark.createDataFrame(rows, "doc_id long, __n long, __p array<double>, __u double"))
    rates = done.collect()
    assert min(r["__rate"] for r in rates if r.doc_id % 10) == 1.0 and max(r["__rate"] for r in rates if r.doc_id % 10 == 0) < 0.3


def test_resample_splits_a_text_once(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = mixing.resample(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Filter" not in plan
