"""The event model from training to report, residual models saved and read, extraction of page text: by function and command."""

import math
from datetime import datetime, timedelta

import pytest

from ebbflow import cli
from ebbflow.operators import harmonic
from ebbflow.plans import workflows

START = datetime(2021, 3, 1)


def level(port: str, t: datetime) -> float:
    h = (t - datetime(2000, 1, 1)).total_seconds() / 3600
    lead = 0.4 if port == "b" else 0.0
    wave = sum(a * math.cos(math.radians(harmonic.SPEEDS[n]) * (h + lead) - p) for n, a, p in (("M2", 1.6, 0.3), ("S2", 0.6, 1.0), ("K1", 0.2, 2.0), ("O1", 0.1, 0.5)))
    return 3.0 + wave


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    at = tmp_path_factory.mktemp("events") / "h.csv"
    rows = [f"{p},{START + timedelta(hours=k)},{level(p, START + timedelta(hours=k)) + 0.02 * math.sin(k / 50):.4f}" for p in "ab" for k in range(24 * 90)]
    at.write_text("port,datetime_ist,height_m\n" + "\n".join(rows) + "\n")
    return str(at)


def true_events(port, start, days):
    minutes = [start + timedelta(minutes=k) for k in range(-1, days * 1440 + 1)]
    y = [level(port, t) for t in minutes]
    return [(port, "High" if y[k] > y[k - 1] else "Low", minutes[k], y[k]) for k in range(1, len(y) - 1) if (y[k] - y[k - 1]) * (y[k + 1] - y[k]) <= 0 and y[k] != y[k - 1]]


def test_events_from_training_to_report(spark, data, tmp_path):
    model_at = str(tmp_path / "model")
    cli.main(["events-train", "--data", data, "--trees", "8", "--depth", "4", "--out", model_at])
    report = {r.port: r for r in spark.read.parquet(f"{model_at}/report").collect()}
    assert set(report) == {"a", "b"} and report["a"].history_rows == 2160 and report["a"].recent_calibration_start == datetime(2018, 1, 1)
    assert report["b"].matched_historical_events > 300 and report["b"].recent_calibration_events == report["b"].matched_historical_events
    assert report["a"].constituent_count == spark.read.parquet(f"{model_at}/harmonics").where("port = 'a' AND nodal").count() > 5

    later = START + timedelta(days=92)
    truth = [e for p in "ab" for e in true_events(p, later, 3)]
    reference = tmp_path / "ref.csv"
    reference.write_text("port,state,datetime_ist,height_m\n" + "\n".join(f"{p},{s.lower()},{t},{h:.3f}" for p, s, t, h in truth) + "\n")
    cli.main(["events-validate", "--model", model_at, "--reference-events", str(reference), "--out", str(tmp_path / "v")])
    rows = {r.port: r for r in spark.read.parquet(str(tmp_path / "v/metrics")).collect()}
    for p in "ab":
        n = sum(e[0] == p for e in truth)
        assert rows[p].observed_events == n and rows[p].match_rate_percent == 100.0 and rows[p].passes_joint_accuracy_gate and rows[p].time_gate_minutes == 30.0
        assert rows[p].time_mae_minutes < 15 and rows[p].height_mae_m < 0.1
    errors = spark.read.parquet(str(tmp_path / "v/errors"))
    assert errors.count() == len(truth)

    cli.main(["events-forecast", "--model", model_at, "--start", str(later.date()), "--days", "2", "--out", str(tmp_path / "f")])
    events = spark.read.parquet(str(tmp_path / "f/events"))
    assert events.columns[2:4] == ["datetime_ist", "datetime_utc"] and {"time_correction_minutes", "raw_height_m"} <= set(events.columns)
    assert all(r.datetime_ist - r.datetime_utc == timedelta(hours=5, minutes=30) for r in events.collect())
    assert spark.read.parquet(str(tmp_path / "f/hourly")).count() == 96

    with pytest.raises(ValueError, match="no model for c"):
        workflows.validate_events(*workflows.load_event_model(spark, model_at), spark.createDataFrame([("c", "High", later, 1.0)], "port string, state string, datetime_ist timestamp_ntz, height_m double"))


def test_residual_models_are_saved_and_used(spark, data, tmp_path):
    fitted = str(tmp_path / "r")
    cli.main(["residual-train", "--data", data, "--window", "24", "--out", fitted])
    skill = {(r.port, r.prediction): r.rmse_m for r in spark.read.parquet(f"{fitted}/skill").collect()}
    assert all(skill[p, "combined_predicted_m"] <= skill[p, "lsm_predicted_m"] for p in "ab")
    start, end = START + timedelta(days=80), START + timedelta(days=82)
    common = ["hybrid-forecast", "--data", data, "--start", str(start), "--window", "24", "--fitted", fitted]
    cli.main([*common, "--hours", "12", "--out", str(tmp_path / "ahead")])
    cli.main([*common, "--mode", "hindcast", "--end", str(end), "--out", str(tmp_path / "back")])
    ahead, back = (spark.read.parquet(str(tmp_path / k)) for k in ("ahead", "back"))
    assert ahead.count() == 24 and back.count() == 96
    assert back.selectExpr("max(abs(combined_predicted_m - height_m)) AS d").first().d < 0.05
    first = {r.port: r.combined_predicted_m for r in back.where(f"datetime_ist = TIMESTAMP_NTZ '{start}'").collect()}
    assert {r.port: r.combined_predicted_m for r in ahead.where(f"datetime_ist = TIMESTAMP_NTZ '{start}'").collect()} == pytest.approx(first, abs=1e-6)
    with pytest.raises(ValueError, match="history"):
        workflows.hybrid_hindcast(workflows.io.read_hourly(spark, data).drop("t_hours"), "1999-01-01", "1999-01-02", workflows.load_residual(spark, fitted), 24)


def put(page, text, x, top, size=7.0):
    return [(page, c, x + 2.0 * k, top, size) for k, c in enumerate(text)]


def event_pages(spark, skip=None, flat=False):
    """A page of April 2026: four events a day, 15 days in each of two columns."""
    chars = []
    for day in range(1, 31):
        if day == skip:
            continue
        col, k = divmod(day - 1, 15)
        top, x = 150.0 + 36.0 * k, (234.5, 253.0, 272.0) if col == 0 else (294.5, 314.0, 333.0)
        chars += put(1, str(day), x[0], top, 10.0)
        for j, (t, h) in enumerate((("0115", "4.62"), ("0730", "1.05"), ("1340", "4.80"), ("1955", "4.90" if flat and day == 9 else "0.95"))):
            chars += put(1, t, x[1], top + 8.0 * j) + put(1, h, x[2], top + 8.0 * j + 0.3)
    return spark.createDataFrame(chars, "page int, text string, x0 double, top double, size double"), spark.createDataFrame([(1, "QUAY", 2026, 4)], "page int, port string, year int, month int")


def test_event_tables_with_gates(spark, tmp_path):
    chars, headers = event_pages(spark)
    events, faults = workflows.extract_events(chars, headers)
    rows = events.orderBy("datetime_ist").collect()
    assert len(rows) == 120 and faults.count() == 0 and [r.state for r in rows[:4]] == ["High", "Low", "High", "Low"]
    assert (rows[5].datetime_ist, rows[5].height_m) == (datetime(2026, 4, 2, 7, 30), 1.05)
    assert {(r.fault, str(r["at"])) for r in workflows.extract_events(*event_pages(spark, skip=7))[1].collect()} == {("days in month", "2026-04-01")}
    assert {r.fault for r in workflows.extract_events(*event_pages(spark, flat=True))[1].collect()} == {"states don't alternate"}
    chars.write.parquet(str(tmp_path / "c"))
    headers.write.parquet(str(tmp_path / "h"))
    cli.main(["extract-events", "--chars", str(tmp_path / "c"), "--headers", str(tmp_path / "h"), "--out", str(tmp_path / "o")])
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 120
    event_pages(spark, skip=7)[0].write.parquet(str(tmp_path / "c7"))
    with pytest.raises(SystemExit, match="days in month"):
        cli.main(["extract-events", "--chars", str(tmp_path / "c7"), "--headers", str(tmp_path / "h"), "--out", str(tmp_path / "o7")])


def test_hourly_pages_and_commands(spark, tmp_path):
    words = [(p, str(d), 10.0, 100.0 + 9.0 * d) for p in (1, 2) for d in (1, 2)] + [(p, f"{p + h / 100:.2f}", 20.0 + h, 100.4 + 9.0 * d) for p in (1, 2) for d in (1, 2) for h in range(24)]
    spark.createDataFrame(words, "page int, text string, x0 double, top double").write.parquet(str(tmp_path / "w"))
    text = "NAME OF PORT:- Quay (Old) MONTH MAY YEAR 2025 x"
    spark.createDataFrame([(1, text), (2, text)], "page int, text string").write.parquet(str(tmp_path / "h"))
    cli.main(["extract-hourly", "--words", str(tmp_path / "w"), "--headers", str(tmp_path / "h"), "--out", str(tmp_path / "o")])
    got = workflows.io.read_hourly(spark, str(tmp_path / "o")).orderBy("datetime_ist").collect()
    assert len(got) == 48 and got[3].height_m == 2.03 and got[3].port == "QUAY" and got[-1].datetime_ist == datetime(2025, 5, 2, 23)


def test_sources_of_models_and_forecasts(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,kind,period_hours,speed_deg_per_hour,amplitude_m,phase_deg,A_cos,B_sin\nM2,semidiurnal,12.42,28.9841042,1.0,90.0,0.0,1.0\n")
    (tmp_path / "s.json").write_text('[{"port": "p", "mean_level_m": 2.5}, {"port": "q", "mean_level_m": 9.0}]')
    model = workflows.io.read_model(spark, str(tmp_path / "c.csv"), str(tmp_path / "s.json"), "p")
    at = workflows.forecast(spark, model, "2000-01-01 00:00:00", 1).first()
    assert (at.port, at.predicted_height_m) == ("p", 2.5)
    with pytest.raises(ValueError, match="no summary"):
        workflows.io.read_model(spark, str(tmp_path / "c.csv"), str(tmp_path / "s.json"), "x")
    (tmp_path / "f.csv").write_text("datetime_ist,lsm_predicted_m,combined_predicted_m\n2025-01-01 00:00:00,1,2\n")
    assert workflows.io.read_forecast(spark, str(tmp_path / "f.csv"), "p").first().height_m == 2.0
    assert workflows.io.read_forecast(spark, str(tmp_path / "f.csv"), "p", "lsm_predicted_m").first().height_m == 1.0
    with pytest.raises(ValueError, match="height"):
        workflows.io.read_forecast(spark, str(tmp_path / "f.csv"), "p", "other")
