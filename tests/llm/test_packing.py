"""Packing steered to other targets than the sources' own shares, over buckets and blocks of buckets."""

import random

import pytest

from ebbflow.llm import packing


def corpus(spark, n=1500):
    r = random.Random(2)
    rows = [(k, " ".join(f"w{r.randrange(999)}" for _ in range(r.randrange(20, 120))), "abc"[0 if k % 10 < 6 else 1 if k % 10 < 9 else 2]) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("targets", [{}, {"a": 0.2, "b": 0.5, "c": 0.3}])
def test_windows_hold_target_shares(spark, targets):
    cfg = packing.PackConfig(targets=targets, bucket_tokens=40_000, window_tokens=4096, block=2)
    docs = corpus(spark)
    rows = packing.pack(docs, cfg).collect()
    tokens = {s: sum(r.length for r in rows if r.source == s) for s in "abc"}
    share = targets or {s: tokens[s] / sum(tokens.values()) for s in "abc"}
    buckets = sorted({r.sequence_id >> 32 for r in rows})
    assert len(buckets) > 3
    whole, before = 0, dict.fromkeys("abc", 0)
    for b in buckets:
        mine = [r for r in rows if r.sequence_id >> 32 == b]
        have = {s: sum(r.length for r in mine if r.source == s) for s in "abc"}
        served = {s: sum(r.length for r in mine if r.source == s and (r.sequence_id & 0xFFFFFFFF) < 4) for s in "abc"}  # a window is four sequences
        assert sum(served.values()) == 4096
        for s in "abc":  # what is owed from earlier buckets and this window is served, as far as there is any
            owed = share[s] * (whole + 4096) - before[s]
            if all(have[x] > 4096 for x in "abc"):
                assert abs(served[s] - min(4096, max(0, owed))) <= 2 or any(share[x] * (whole + 4096) - before[x] < 0 for x in "abc")
        if b == buckets[0] and all(have[s] > 3 * 4096 * share[s] for s in "abc"):
            later = {s: sum(r.length for r in mine if r.source == s and 4 <= (r.sequence_id & 0xFFFFFFFF) < 12) for s in "abc"}
            assert all(abs(later[s] / 8192 - share[s]) < 0.01 for s in "abc")
        whole, before = whole + sum(have.values()), {s: before[s] + have[s] for s in "abc"}
    assert before == tokens


def test_prefix_sums_in_two_levels(spark):
    r = random.Random(3)
    cells = [(b, s, r.randrange(100)) for b in range(50) for s in "ab" if r.random() < 0.7]
    df = spark.createDataFrame(cells, "bucket long, source string, n long")
    got = {(x.bucket, x.source): x.before for x in packing._before(df, ["source"], packing.PackConfig(block=4)).collect()}
    assert got == {(b, s): sum(n for c, t, n in cells if t == s and c < b) for b, s, _ in cells}
    whole = df.groupBy("bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    got = {x.bucket: x.before for x in packing._before(whole, [], packing.PackConfig(block=4)).collect()}
    assert all(v == sum(n for c, _, n in cells if c < b) for b, v in got.items())
