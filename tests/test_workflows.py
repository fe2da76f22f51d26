"""The command line end to end on a synthetic port, and streaming ingestion."""

import math
from datetime import datetime, timedelta

import pytest

from ebbflow import cli
from ebbflow.operators import harmonic
from ebbflow.plans import workflows
from ebbflow.streaming import ingest


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    at = tmp_path_factory.mktemp("data") / "p.csv"
    start = datetime(2019, 1, 1)
    t0 = (start - datetime(2000, 1, 1)).total_seconds() / 3600
    rows = [f"p,{start + timedelta(hours=h)},{3 + 1.6 * math.cos(math.radians(28.9841042) * (t0 + h)) + 0.5 * math.cos(math.radians(30) * (t0 + h)):.3f}" for h in range(24 * 120)]
    at.write_text("port,datetime_ist,height_m\n" + "\n".join(rows) + "\n")
    return str(at)


def test_train_and_forecast(spark, data, tmp_path):
    cli.main(["train-predict", "--data", data, "--out", str(tmp_path / "a")])
    s = spark.read.parquet(str(tmp_path / "a/summary")).first()
    assert s.train.n == 2592 and s.valid.n == 288 and s.datums_19yr.RA == pytest.approx(s.datums_19yr.HAT - s.datums_19yr.LAT)
    assert spark.read.parquet(str(tmp_path / "a/sample")).count() == 720
    small = harmonic.fit(workflows.io.read_hourly(spark, data), ["M2", "S2"])
    small.write.parquet(str(tmp_path / "m"))
    cli.main(["forecast", "--model", str(tmp_path / "m"), "--start", "2019-05-01", "--hours", "48", "--out", str(tmp_path / "f")])
    assert spark.read.parquet(str(tmp_path / "f")).count() == 48
    cli.main(["events-forecast", "--model", str(tmp_path / "m"), "--start", "2019-05-01", "--hours", "48", "--out", str(tmp_path / "e")])
    counts = {r.state: r["count"] for r in spark.read.parquet(str(tmp_path / "e/frequency")).collect()}
    assert all(3 <= counts[s] <= 5 for s in ("High", "Low"))
    with pytest.raises(ValueError):
        workflows.forecast(spark, small, "2019-05-01", 0)


def test_report(spark, data):
    curve = workflows.io.read_hourly(spark, data).drop("t_hours")
    observed = workflows.io.read_hourly(spark, data).limit(0).selectExpr("port", "'High' AS state", "datetime_ist", "height_m")
    t = workflows.tide_report(curve, "2019-01-10", 24, observed)
    assert t["hourly"].count() == 24 and t["errors"].count() == 0 and 3 <= t["events"].count() <= 5
    with pytest.raises(ValueError):
        workflows.tide_report(curve, "1999-01-10")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("port,datetime_ist,height_m\np,2020-01-01 00:10:00,1\np,2020-01-01 00:40:00,3\np,2020-01-01 09:00:00,5\n")
    q = ingest.write_hourly(ingest.hourly_means(ingest.read_gauges(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.port, r.height_m) for r in rows] == [("p", 2.0)]
