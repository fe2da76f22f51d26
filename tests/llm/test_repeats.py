"""Passages whose partners stand apart in both orders, runs over partition borders, ties."""

import os
import random

import pytest
import test_methods as M

from ebbflow.llm import repeats


def marks(spark, docs, cfg=repeats.RepeatConfig(), parts=6):
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    got = {}
    for x in repeats.repeated_passages(df.repartition(parts), cfg).collect():
        mark = got.setdefault(x.doc_id, [False] * len(docs[x.doc_id]))
        mark[x.start_word : x.end_word] = [True] * x.n_words
        assert x.other_doc_id != x.doc_id and x.n_words == x.end_word - x.start_word >= 50
    return got


def filler(r, n):
    return [f"f{r.randrange(10**9)}" for _ in range(n)]


@pytest.mark.parametrize("hot", [2000, 3])
def test_crossed_contexts(spark, hot):
    """A core between many left and many right contexts: only equal combinations make 50 words."""
    r = random.Random(12)
    core, lefts, rights = filler(r, 20), [filler(r, 15) for _ in range(30)], [filler(r, 15) for _ in range(30)]
    pairs = [(i, j) for i in range(30) for j in range(30)]
    r.shuffle(pairs)
    docs, n = {}, 0
    for i, j in pairs[:40] * 2 + pairs[40:400]:
        docs[n] = filler(r, r.randrange(30)) + lefts[i] + core + rights[j] + filler(r, 30)
        n += 1
    expected = M.brute_passages(docs)
    assert len(expected) == 80 and marks(spark, docs, repeats.RepeatConfig(hot=hot)) == expected


def test_one_document_fills_the_neighbourhood(spark):
    """Two documents share a passage; one of them holds its anchor very often, over partition borders."""
    r = random.Random(13)
    passage, line = filler(r, 60), filler(r, 12)
    docs = {1: filler(r, 20) + passage + filler(r, 20), 2: passage, 3: [w for _ in range(400) for w in line + filler(r, 45)], 4: line * 10 + filler(r, 60), 5: line * 30}
    assert marks(spark, docs) == M.brute_passages(docs)


def test_ties_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(70))
    df = spark.createDataFrame([(1, text), (1, text), (1, text + " more"), (2, text), (None, text), (3, None), (4, " "), (5, "w " * 300)], "doc_id long, text string")
    got = sorted((x.doc_id, x.start_word, x.end_word, x.other_doc_id) for x in repeats.repeated_passages(df).collect())
    assert got == [(1, 0, 70, 2), (1, 0, 70, 2), (2, 0, 70, 1)]


LARGE = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables here")
def test_all_repeated_words_of_the_tables(spark):
    docs = {d: M.WORD.findall(t) for d, t in M.documents(spark, LARGE).items()}
    assert marks(spark, docs) == M.brute_passages(docs)
