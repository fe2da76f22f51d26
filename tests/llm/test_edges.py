"""Nulls in any column, empty and very long texts, repeated rows, empty tables, extra and clashing columns."""

import pytest

from ebbflow.llm import exact, htmltext, mixing, near, packing, quality, repeats, secrets, toxicity, warc

LONG = " ".join(f"word{k % 997}" for k in range(60_000))
GOOD = " ".join(f"alpha{k} beta{k % 7}" for k in range(40))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, component_id long, bucket int, score double, row string"
ROWS = [
    (1, GOOD, "en", "s1", 1, True, "x", 9, 3, 0.5, "r"),
    (1, GOOD, "en", "s1", 1, True, "x", 9, 3, 0.5, "r"),  # repeated row
    (2, GOOD + " more", "en", None, None, None, None, None, None, None, None),
    (None, GOOD, None, "s1", 1, False, "y", 1, 1, 0.1, "r"),
    (3, None, "en", "s2", None, True, None, 1, 1, 0.1, None),
    (4, "", None, None, 0, True, None, 1, 1, 0.1, None),
    (5, " \t\n ", "de", "s2", 3, True, None, 1, 1, 0.1, None),
    (6, "a b", "de", "s2", 3, True, None, 1, 1, 0.1, None),
    (7, LONG, "de", "s2", len(LONG), True, None, 1, 1, 0.1, None),
    (8, "x" * 200_000, "de", "s2", 200_000, True, None, 1, 1, 0.1, None),
    (-3, "Ünïcödé ☃ " * 60, "fr", "s3", 1, True, None, 1, 1, 0.1, None),
]
LABELS = [(1, 1, 0), (2, 0, None), (3, None, 1), (None, 1, 1), (7, 1, 1), (7, 1, 0), (99, 0, 1), (-3, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_quality(docs, nothing):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[7].n_words == 60_000 and by[8].word_chars == 200_000 and by[-3].n_words == 120
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sum(r.text == GOOD for r in kept.collect()) == 3
    assert quality.judge(nothing).count() == 0 and quality.keep_good(nothing).columns == docs.columns


def test_exact(spark, docs, nothing):
    rows = exact.DigestIndex.fresh(spark, 4).assign(docs).collect()
    assert len(rows) == len(ROWS)
    group = [r for r in rows if r.group_size == 3 and r.keep_id == 1]
    assert sorted((r.doc_id or 0, r.kept) for r in group) == [(0, False), (1, True), (1, True)]
    blank = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert {r.keep_id for r in blank} == {5} and all(r.group_size == 3 for r in blank)
    kept = exact.DigestIndex.fresh(spark, 4).drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [-3, 1, 2, 5, 6, 7, 8]
    assert exact.DigestIndex.fresh(spark, 4).assign(nothing).count() == 0
    assert exact.DigestIndex.fresh(spark, 4).drop_copies(nothing).count() == 0


def test_exact_index_persists(spark, docs):
    index = exact.DigestIndex.fresh(spark, 4)
    index.assign(docs.where("doc_id = 2")).collect()
    later = index.assign(docs.where("doc_id = 2").selectExpr("doc_id + 100 AS doc_id", "text")).collect()
    assert [(r.doc_id, r.keep_id, r.kept) for r in later] == [(102, 2, False)]
    assert index.drop_copies(docs.where("doc_id IN (2, 6)")).count() == 1


def test_near(docs, nothing):
    rows = near.near_components(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept and by[None].component_id == 1
    assert all(by[k].n_shingles == 0 and by[k].component_id == k and by[k].kept for k in (3, 4, 5))
    assert by[6].n_shingles == 1 and by[8].n_shingles == 1
    kept = near.drop_near_copies(docs)
    assert kept.columns == docs.columns and 2 not in {r.doc_id for r in kept.collect()}
    assert near.near_components(nothing).count() == 0 and near.drop_near_copies(nothing).count() == 0


def test_mixing(docs, nothing, labels):
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in rows)
    clashing = docs.selectExpr("*", "1 AS __n", "2 AS __p", "3 AS __w", "4 AS __copies")
    kept = sorted(r.doc_id or 0 for r in rows if r.kept)
    for cfg in (mixing.MixConfig(), mixing.MixConfig(most_copies=3.0, scarce="thin")):
        again = mixing.resample(clashing, labels, cfg)
        assert again.columns == clashing.columns
        if cfg.most_copies == 1:
            assert sorted(r.doc_id or 0 for r in again.collect()) == kept and all(0 <= r.rate <= 1 for r in rows)
        else:
            assert len(again.collect()) == sum(r.copies for r in mixing.mix(docs, labels, cfg).collect())
    assert mixing.mix(nothing, labels).count() == 0 and mixing.resample(nothing, labels).count() == 0
    assert len({round(r.p_good, 9) for r in mixing.mix(docs, labels.limit(0)).collect()}) == 1


def test_packing(docs, nothing):
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows if r.doc_id in (3, 4)) == 2
    assert sum(r.start == 0 for r in rows if r.doc_id == 1) == 2 and any(r.doc_id is None for r in rows)
    assert packing.pack(nothing).count() == 0


def test_toxicity(docs, nothing, labels):
    weights = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, weights).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score(nothing, weights).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_secrets(spark, docs, nothing):
    assert secrets.scan(docs).where("doc_id IN (3, 4, 5)").count() == 0
    assert secrets.scan(nothing).count() == 0


def test_repeats(docs, nothing):
    rows = repeats.repeated_passages(docs).collect()
    assert {(r.doc_id, r.other_doc_id, r.n_words) for r in rows} == {(1, 2, 80), (2, 1, 80)}
    assert repeats.repeated_passages(nothing).count() == 0


PAGES = [(1, "http://a/x", "<p>one</p>" * 20, 1), (2, "http://a/y", "<p>one</p>" * 20, 1), (2, "http://a/y", "<p>one</p>" * 20, 1), (3, None, None, 1), (None, "odd", "<div>" + "long " * 50_000, None), (4, "http://a/z", "", 1), (5, "x\r\ny", "short", 1), (6, "http://b/", "short", 1)]


def test_warc(spark):
    schema = "page_id long, url string, html string, refers_to long"
    rows = warc.round_trip(spark, spark.createDataFrame(PAGES, schema)).collect()
    assert len(rows) == len(PAGES) and all(r.record_digest_ok for r in rows)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows if r.record_type == "revisit") == [(2, "revisit", 1), (2, "revisit", 1)]
    assert {r.page_id for r in rows} == {1, 2, 3, 4, 5, 6, None}
    assert warc.round_trip(spark, spark.createDataFrame([], schema)).count() == 0


def test_html(spark):
    schema = "page_id long, url string, html string, text string"
    pages = spark.createDataFrame([(p, u, h, "t") for p, u, h, _ in PAGES], schema)
    rows = htmltext.extract(pages).collect()
    assert len(rows) == len(PAGES) and all(r.n_chars == len(r.text) for r in rows)
    assert {r.page_id: r.text for r in rows}[3] == "" and {r.page_id: r.n_chars for r in rows}[None] == 249_999
    assert htmltext.extract(spark.createDataFrame([], schema)).count() == 0
