"""Archives: repeated ids, borders of shards, and commits that a lost driver left half done."""

import random

import pytest

from ebbflow.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_one_id_with_different_payloads(spark):
    a, b, small = "<p>a</p>" * 30, "<p>b</p>" * 30, "tiny"
    rows = [(1, "u1", a), (5, "u5", a), (5, "u5", b), (5, "u5", small), (6, "u6", small), (7, "u7", b), (7, "u7", a)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert found == sorted([(1, 240, "response", None), (5, 240, "revisit", 1), (5, 240, "response", None), (5, 4, "response", None), (6, 4, "response", None), (7, 240, "revisit", 5), (7, 240, "revisit", 1)])


@pytest.mark.parametrize("spread", [1, 10**12])
def test_shards_are_equal_in_every_write(spark, tmp_path, spread):
    r = random.Random(1)
    rows = [(k * spread if k % 3 else k, f"http://h/{k}", f"<p>{k}</p>" * r.randrange(1, 40)) for k in range(10_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = warc.write_archive(df.repartition(5), f"file://{tmp_path}/a", shards=4)
    two = warc.write_archive(df.repartition(3), f"file://{tmp_path}/b", shards=4)
    assert one == two and len(one) == 4 and sum(m["records"] for m in one) == len(rows)
    assert max(m["bytes"] for m in one) < 1.5 * min(m["bytes"] for m in one), [(m["bytes"], m["records"]) for m in one]
    assert all(a["last_id"] < b["first_id"] for a, b in zip(one, one[1:], strict=False))


def test_shard_starts_split_one_heavy_range(spark):
    sizes = spark.createDataFrame([(-(2**62), 1), (2**62, 1)] + [(k, 10) for k in range(1000)], "page_id long, bytes long")
    starts = warc.shard_starts(sizes, 10)
    assert len(starts) == 9 and all(0 < s < 1000 for s in starts) and all(50 <= b - a <= 150 for a, b in zip(starts, starts[1:], strict=False))
    assert warc.shard_starts(sizes.limit(0), 10) == [] and warc.shard_starts(spark.createDataFrame([(3, 5)] * 9, "page_id long, bytes long"), 4) == []


def test_commit_is_finished_or_cleaned(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, "u", f"page {k}") for k in range(500)], SCHEMA)
    whole = warc.write_archive(df, f"file://{tmp_path}/whole", shards=5)
    with pytest.raises(FileExistsError):
        warc.write_archive(df, f"file://{tmp_path}/whole")

    def lost(root):  # the driver goes after two renames
        import json

        fs, base = warc._files(root)
        for m in json.load(open(f"{base}/commit.json"))[:2]:
            fs.move(f"{base}/{m['temporary']}", f"{base}/{m['file']}")
        raise KeyboardInterrupt

    for at in ("resumed", "rewritten"):
        with monkeypatch.context() as m:
            m.setattr(warc, "resume_commit", lost)
            with pytest.raises(KeyboardInterrupt):
                warc.write_archive(df, f"file://{tmp_path}/{at}", shards=5)
    assert warc.resume_commit(f"file://{tmp_path}/resumed") == whole == warc.resume_commit(f"file://{tmp_path}/resumed")
    other = warc.write_archive(df.where("page_id < 100"), f"file://{tmp_path}/rewritten", shards=1)
    assert sorted(p.name for p in (tmp_path / "rewritten").iterdir()) == ["manifest.json", *(m["file"] for m in other)]
    assert warc.read_archive(spark, f"file://{tmp_path}/resumed").count() == 500
