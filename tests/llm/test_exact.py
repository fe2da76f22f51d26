"""The digest index: its plan, batches tried again, compaction, rows that share an id."""

from ebbflow.llm import exact

SCHEMA = "doc_id long, text string, __id string, note string"


def rows(spark, *items):
    return spark.createDataFrame([(d, t, "x", n) for d, t, n in items], SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_plan_has_the_anti_join(spark):
    index = exact.DigestIndex.fresh(spark, 4)
    winners = spark.createDataFrame([(bytearray(b"a"), 1)], "digest binary, keep_id long")
    assert "SortMergeJoin" in plan(index.unseen(winners, "b")) and "LeftAnti" in plan(index.unseen(winners, "b"))
    assert plan(index.unseen(winners, "b")).count("Exchange") <= 1  # the index side is read by its buckets
    index.drop()
    assert not index.exists()


def test_a_named_batch_may_be_tried_again(spark):
    index = exact.DigestIndex.fresh(spark, 4)
    one, two = rows(spark, (1, "a b", ""), (2, "ab", ""), (3, "c", "")), rows(spark, (4, "c", ""), (5, "d", ""))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(index.drop_copies(one, batch="one")) == [1, 3]
    assert ids(index.drop_copies(one, batch="one")) == [1, 3] and index.read().count() == 2
    assert ids(index.drop_copies(two, batch="two")) == [5] and ids(index.drop_copies(two, batch="two")) == [5]
    assert ids(index.drop_copies(one, batch="three")) == []
    index.compact()
    assert index.read().count() == 3 and ids(index.drop_copies(two, batch="four")) == []
    assert [(r.doc_id, r.keep_id) for r in index.assign(rows(spark, (9, "c ", ""))).collect()] == [(9, 3)]


def test_rows_that_share_an_id(spark):
    index = exact.DigestIndex.fresh(spark, 4)
    docs = rows(spark, (7, "one", "a"), (7, "two", "b"), (7, "two", "c"), (8, "t w o", "d"), (None, "three", "e"), (None, "three", "e"), (9, "o n e", "f"), (9, "one ", "g"))
    got = sorted((r.doc_id or 0, r.text) for r in index.drop_copies(docs).collect())
    assert got == [(0, "three"), (8, "t w o"), (9, "o n e")]
    for bound in (0, 10**6):
        index = exact.DigestIndex.fresh(spark, 4)
        big = spark.range(400).selectExpr("id AS doc_id", "concat('t', id % 150) AS text")
        assert sorted(r.doc_id for r in index.drop_copies(big, broadcast_rows=bound).collect()) == list(range(150))
        index = exact.DigestIndex.fresh(spark, 4)
        assert index.drop_copies(big.where("id < 160"), broadcast_rows=bound).count() == 150
