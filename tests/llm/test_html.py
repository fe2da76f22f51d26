"""Extraction by differencing: against a plain differencer, and names that only look like boilerplate."""

import os
import random

import pytest

from ebbflow.llm import htmltext

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def common(a, b):
    """Places in b of a longest common subsequence of two lists of distinct lines in one order."""
    return {j for j, x in enumerate(b) if x in a}


def plain_difference(pages):
    """pages: [(path, lines)] of one host in order of path; the lines that a page without a container keeps."""
    out = {}
    for k, (path, own) in enumerate(pages):
        sides = []
        for other in ([pages[k - 1]] if k else []) + ([pages[k + 1]] if k + 1 < len(pages) else []):
            at = common(other[1], own)
            sides.append((at, 2 * sum(len(own[j]) for j in at) > sum(map(len, own))))
        gone = set.intersection(*(s for s, _ in sides)) if len(sides) == 2 else set()
        for s, close in sides:
            gone |= set() if close else s
        out[path] = " ".join([x for j, x in enumerate(own) if j not in gone] or own)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pages_without_containers_equal_a_plain_differencer(spark, seed):
    r = random.Random(seed)
    template = [f"template line {k} of the site" for k in range(12)]
    pages = []
    for k in range(30):
        head = [t for t in template[:6] if r.random() < 0.8]
        tail = [t for t in template[6:] if r.random() < 0.8]
        story = [f"story {k} has line {j} " + "and more text " * r.randrange(12) for j in range(r.randrange(1, 6))]
        pages.append((f"/s/{k:03d}", head + [x.strip() for x in story] + tail))
    rows = [(k, f"http://h.example/{p[1:]}?x={r.random()}", "<html><body>" + "".join(f"<div>{x}</div>" for x in ls) + "</body></html>") for k, (p, ls) in enumerate(pages)]
    expected = plain_difference(pages)
    got = texts(spark, rows)
    assert got == {k: expected[p] for k, (p, _) in enumerate(pages)}
    alone = texts(spark, [(k, f"http://host{k}/", h) for k, _, h in rows])  # without neighbours nothing is deleted
    assert alone == {k: " ".join(ls) for k, (_, ls) in enumerate(pages)}
    assert sum(x.count("template line") for x in got.values()) < 0.3 * sum(x.count("template line") for x in alone.values())


def test_template_lines_inside_articles_go_by_differencing(spark):
    rows = [(k, f"http://h/{k}", f"<article><p>Read our app</p><p>Own text {k} is this long here</p><p>{'Quoted alike' if k in (3, 4, 5) else k}</p></article>") for k in range(12)]
    got = texts(spark, rows)
    assert got[4] == "Own text 4 is this long here Quoted alike" and got[8] == "Own text 8 is this long here 8"
    assert texts(spark, rows[4:5])[4] == "Read our app Own text 4 is this long here Quoted alike"


def test_names_that_only_look_like_boilerplate(spark):
    article = (
        '<article><p>one</p><p class="social-history">two</p><p id="ad-hoc">three</p><p class="notice-period">four</p><section id="discussion">five</section>'
        '<div class="ad-slot">x</div><div class="lead commentList">x</div><div id="comments">x</div><div class="cookieNotice">x</div><div class="share-buttons">x</div><p class="related-work">six</p></article>'
    )
    bare = '<body><div class="menuItems">x</div><p>alpha</p><div class="site-header">x</div><p class="broadcast">beta</p><div class="login-form">x</div></body>'
    got = texts(spark, [(1, "http://a/1", article), (2, "http://b/2", bare)])
    assert got == {1: "one two three four five six", 2: "alpha beta"}


LARGE = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables here")
def test_articles_of_the_tables(spark):
    import html
    import re

    pages = spark.read.parquet(f"{LARGE}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.sub(r"</?b>", "", inner)
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", blocks)).split()), r.page_id
