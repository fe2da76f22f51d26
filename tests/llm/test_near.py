"""Near copies: joins beyond the broadcast bound, and ids that stand on different texts."""

import test_methods as M

from ebbflow.llm import near


def test_salted_joins_give_the_same(spark):
    docs = M.family(5)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    cfg = near.NearConfig(block=8, broadcast_rows=0, salts=3)
    assert {r.doc_id: r.component_id for r in near.near_components(df, cfg).collect()} == M.brute_components(docs)


def test_sizes_far_apart(spark):
    base = [f"w{k}" for k in range(400)]
    docs = {k: " ".join(base[: 100 + 7 * (k % 43)]) + f" e{k}" for k in range(120)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.near_components(df, near.NearConfig(block=8)).collect()} == M.brute_components(docs)


def test_an_id_on_two_texts_loses_none(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text + " end"), (7, text + " more"), (7, "all of this is something else " * 5), (8, text), (8, text)]
    kept = near.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 7, 7]
