"""Cases that shortened versions of the operators got wrong."""

import random

import duckdb
import numpy as np
import pyarrow as pa

from ebbflow.llm import mixing, quality, queries, repeats, wordhash


def _labelled(spark, texts):
    """Documents and labels of [(lang, domain, text)]."""
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, _, text) in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(d == 0), int(d == 2)) for i, (_, d, _) in enumerate(texts)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_mixing_minority_language_posteriors(spark):
    texts = [("en", 0, f"the river was high near town {i}") for i in range(600)]
    texts += [("en", 2, f"the river you idiot number {i}") for i in range(200)]
    texts += [("de", 0, f"der fluss war hoch bei stadt {i}") for i in range(60)]
    texts += [("de", 2, f"der fluss du holzkopf nummer {i}") for i in range(8)]  # 4% of the toxic texts
    docs, labels = _labelled(spark, texts)
    found = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    for i, (lang, domain, _) in enumerate(texts):
        assert (found[i].p_toxic if domain else found[i].p_good) > 0.5, (lang, domain)


def test_mixing_knows_junk_by_its_ending(spark):
    texts = [("en", 0, f"river{i} bank{i} town{i}") for i in range(300)]
    texts += [("en", 1, f"stone{i}&&& field{i}&&& road{i}&&&") for i in range(60)]  # no whole word occurs twice
    docs, labels = _labelled(spark, texts)
    found = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    for i, (_, domain, _) in enumerate(texts):
        assert (found[i].p_poor if domain else found[i].p_good) > 0.5, domain


def test_mixing_posteriors_of_long_junk(spark):
    model = mixing.Model((-5.0, -5.0), {"a&&&": (90.0, 70.0)}, (-3.0, -3.0))
    p = mixing.with_posteriors(spark.createDataFrame([("so a&&&",)], "text string"), model, mixing.MixConfig()).first()["__p"]
    assert p[1] > 0.99 and abs(sum(p) - 1.0) < 1e-12


def test_quality_fence_of_a_junk_heavy_source(spark):
    def text(k, marks):
        return " ".join(f"w{k}x{i}{'#' if i < marks else ''}" for i in range(80))

    rows = [(k, text(k, 0), "en", "clean") for k in range(700)]
    rows += [(1000 + k, text(1000 + k, 0), "en", "mixed") for k in range(210)]
    rows += [(2000 + k, text(2000 + k, 40 + k % 40), "en", "mixed") for k in range(90)]  # 30% of the source
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.kept for x in quality.judge(docs).collect()}
    assert all(kept == (d < 2000) for d, kept in got.items())
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    column = [c[0] for c in db.execute(queries.OP4_SQL).description].index("kept")
    assert {r[0]: r[column] for r in db.execute(queries.OP4_SQL).fetchall()} == got


def test_minimisers_cover_uneven_repeats():
    at = np.array([0, 19, 58, 70, 75, 112, 150])
    kept, _ = repeats._thinned(at, np.full(len(at), 7, np.uint64), np.zeros(len(at), np.int64), 20, 40)
    assert np.diff(kept).max() <= 40 and kept[0] == 0 and kept[-1] == 150
    cfg = repeats.RepeatConfig()
    r = random.Random(3)
    line = " ".join(f"w{k}" for k in range(11))  # a refrain between uneven verses
    for _ in range(300):
        text = " ".join(f"{line} " + " ".join(f"v{r.randrange(10**6)}" for _ in range(r.randrange(0, 30))) for _ in range(40))
        for c in wordhash.chunks(pa.array([text])):
            at, _ = repeats.minimisers(c, cfg)
            assert np.diff(np.concatenate([[-1], at, [len(c.word) - cfg.anchor + 1]])).max() <= cfg.window
