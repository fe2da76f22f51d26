"""Kernels against brute force, models against what made the data, and edge cases."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from ebbflow.functions import scalars
from ebbflow.operators import extraction, harmonic, metrics, peaks, residual, series, turning
from ebbflow.sources import io

START = datetime(2020, 1, 1)


def frame(spark, values, port="a", hours=None):
    hours = range(len(values)) if hours is None else hours
    return spark.createDataFrame([(port, START + timedelta(hours=h), float(v)) for h, v in zip(hours, values)], "port string, datetime_ist timestamp_ntz, height_m double")


def brute_peaks(x, distance, prominence):
    found, i = [], 1
    while i < len(x) - 1:
        if x[i] > x[i - 1]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    left = list(found)
    for p in sorted(found, key=lambda p: (x[p], found.index(p)), reverse=True):
        if p in left:
            left = [q for q in left if q == p or abs(q - p) >= distance]
    out = []
    for p in left:
        a = b = p
        while a >= 0 and x[a] <= x[p]:
            a -= 1
        while b < len(x) and x[b] <= x[p]:
            b += 1
        if x[p] - max(min(x[a + 1 : p + 1]), min(x[p:b])) >= prominence:
            out.append(p)
    return out


def test_find_peaks_kernel():
    r = random.Random(1)
    for _ in range(400):
        x = np.array([r.randint(0, 8) / 2 for _ in range(r.randint(5, 40))])
        assert sorted(peaks.find_peaks(x, 4, 0.5)) == sorted(brute_peaks(list(x), 4, 0.5))


def test_prominent_events_distributed(spark):
    r = random.Random(2)
    hours, values, h = [], [], 0
    for k in range(400):
        h += 1 if r.random() > 0.03 else r.randint(2, 30)
        hours.append(h)
        values.append(round(3 + 2 * math.sin(h / 2) + r.random(), 1))
    got = {(e.state, e.datetime_ist) for e in peaks.prominent_events(frame(spark, values, hours=hours)).collect()}
    expected = set()
    blocks, at = [], [0]
    for k in range(1, len(hours)):
        if hours[k] - hours[k - 1] != 1:
            blocks.append(at)
            at = []
        at.append(k)
    blocks.append(at)
    for b in blocks:
        if len(b) < 5:
            continue
        x = np.array([values[k] for k in b])
        for state, sign in (("High", 1), ("Low", -1)):
            for p in brute_peaks(list(sign * x), 4, 0.5):
                a, c, f = (x[p - 1], x[p], x[p + 1])
                q, s = (a - 2 * c + f) / 2, (f - a) / 2
                o = max(-1.0, min(1.0, -s / (2 * q))) if q else 0.0
                expected.add((state, START + timedelta(hours=hours[b[p]], microseconds=round(o * 3_600_000_000))))
    near = lambda a, b: a[0] == b[0] and abs((a[1] - b[1]).total_seconds()) < 1e-5
    assert len(got) == len(expected) and all(any(near(g, e) for e in expected) for g in got)


def test_prominent_events_of_nothing(spark):
    assert peaks.prominent_events(frame(spark, [])).count() == 0
    assert peaks.prominent_events(frame(spark, [1, 5, 1, 0])).count() == 0  # a block of four


def brute_match(obs, pred, most):
    used, out = set(), []
    for o, (t, _) in enumerate(obs):
        best = min(((abs(p[0] - t), p[2], k) for k, p in enumerate(pred) if k not in used and (most is None or abs(p[0] - t) <= most)), default=None)
        if best:
            used.add(best[2])
            out.append((o, best[2]))
    return out


@pytest.mark.parametrize("most", [None, 10, 180])
def test_match_greedy(most):
    r = random.Random(3)
    for _ in range(500):
        obs = sorted((r.randint(0, 60), 0.0) for _ in range(r.randint(0, 12)))
        pred = sorted(((r.randint(0, 60), 0.0, k) for k in range(r.randint(0, 12))), key=lambda p: (p[0], p[2]))
        assert peaks.match_greedy(obs, pred, most) == brute_match(obs, pred, most)


def test_match_events(spark):
    def events(minutes, shift=0):
        return spark.createDataFrame([("a", "High", START + timedelta(minutes=m + shift), 1.0) for m in minutes], "port string, state string, datetime_ist timestamp_ntz, height_m double")

    got = peaks.match_events(events([0, 10, 1000, 5000]), events([5, 1180, 5181])).collect()
    assert {(int((g.observed_datetime_ist - START).total_seconds() / 60), g.time_error_minutes) for g in got} == {(0, 5.0), (1000, 180.0)}


def test_harmonic_recovers(spark):
    names = ["M2", "S2", "K1", "O1"]
    terms = {n: (0.5 + k, 1.0 - k) for k, n in enumerate(names)}
    hours = range(24 * 400)
    t0 = (START - datetime(2000, 1, 1)).total_seconds() / 3600
    y = [3.0 + sum(a * math.cos(math.radians(harmonic.SPEEDS[n]) * (t0 + h)) + b * math.sin(math.radians(harmonic.SPEEDS[n]) * (t0 + h)) for n, (a, b) in terms.items()) for h in hours]
    s = frame(spark, y)
    model = harmonic.fit(s, names)
    for r in model.collect():
        assert (r.A_cos, r.B_sin) == pytest.approx(terms[r.name], abs=1e-8) and r.mean_level_m == pytest.approx(3.0)
        assert 0 <= r.phase_deg < 360
    worst = harmonic.predict(s, model).selectExpr("max(abs(predicted_m - height_m)) AS d").first().d
    assert worst < 1e-7
    nodal = model.withColumn("nodal", model["port"].isNotNull())
    modulated = harmonic.predict(s, nodal, "h").selectExpr("port", "datetime_ist", "h AS height_m")
    assert modulated.join(s.withColumnRenamed("height_m", "y"), ["port", "datetime_ist"]).selectExpr("max(abs(height_m - y)) AS d").first().d > 0.01
    for trend in (True, False):  # a model fitted with nodal factors is predicted with them, trend or not
        again = harmonic.fit(modulated, names, trend=trend, nodal=True)
        assert harmonic.predict(modulated, again).selectExpr("max(abs(predicted_m - height_m)) AS d").first().d < 1e-6
    again = harmonic.fit(modulated, names, trend=True, nodal=True)
    for r in again.collect():
        assert (r.A_cos, r.B_sin) == pytest.approx(terms[r.name], abs=1e-6) and r.trend_m_per_year == pytest.approx(0.0, abs=1e-6)
    with pytest.raises(ValueError, match="M99"):
        harmonic.fit(s, ["M2", "M99"])
    short = s.limit(0).unionByName(s.orderBy("datetime_ist").limit(24 * 3).selectExpr("'short' AS port", "datetime_ist", "height_m")).unionByName(s)
    own = {p: {r.name for r in harmonic.fit(short, rayleigh=True).collect() if r.port == p} for p in ("short", s.first().port)}
    assert own["short"] == set(harmonic.resolvable(list(harmonic.SPEEDS), 72.0)) and own["short"] < own[s.first().port]
    assert set(harmonic.resolvable(list(harmonic.SPEEDS), 24 * 30.0)) < set(harmonic.SPEEDS)


def test_partitions_do_not_matter(spark):
    s = frame(spark, [math.sin(k / 3) for k in range(500)])
    rows = [sorted(map(tuple, turning.turning_points(s.repartition(n), bucket=b).collect())) for n in (1, 8) for b in (None, "DAY")]
    assert all(r == rows[0] for r in rows)


def test_turning_point_edges(spark):
    got = turning.turning_points(frame(spark, [2, 1, 1, 1, 3, 3, 2])).orderBy("datetime_ist").collect()
    assert [(g.state, g.is_boundary_estimate) for g in got] == [("High", True), ("Low", False), ("High", False)]
    assert turning.turning_points(frame(spark, [1.0])).count() == 0
    assert turning.turning_points(frame(spark, [1.0, 1.0])).count() == 0
    freq = turning.event_frequency(turning.turning_points(frame(spark, [2, 1, 3])), with_utc=True).collect()
    assert {(f.state, f["count"]) for f in freq} == {("High", 1), ("Low", 1)} and all(f.average_interval_hours is None for f in freq)


def test_skill_edges(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 1.0)], "port string, o double, p double")
    r = metrics.skill_metrics(df, "o", "p", ["port"]).first()
    assert (r.n, r.bias_m, r.rmse_m, r.r, r.sr) == (2, 1.0, 1.0, None, None)
    gaps = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 2.0), ("a", 1.0, None)], "port string, o double, p double")
    assert metrics.skill_metrics(gaps, "o", "p", ["port"]).first().n == 1
    assert metrics.histogram(df, "o", "port").collect()[0].n == 2


def test_windows_and_splits(spark):
    for n, windows in ((0, 0), (1, 0), (168, 0), (169, 1), (200, 32)):
        assert series.sliding_windows(frame(spark, list(range(n)))).count() == windows
    s = frame(spark, range(10), hours=[0, 1, 2, 3, 4, 50, 51, 52, 53, 54])
    assert series.sliding_windows(s, 3, contiguous_only=True).count() == 4
    assert series.block_summary(s).where("usable").count() == 2
    r = series.split_summary(frame(spark, range(15))).first()
    assert (r.n_train, r.n_valid) == (13, 2)


def test_residual_model(spark):
    r = random.Random(5)
    z, y = 0.0, []
    for h in range(1500):
        z = 0.9 * z + r.gauss(0, 0.1)
        y.append(3 + math.cos(math.radians(28.9841042) * h) + z)
    s = frame(spark, y)
    lsm, model, test = residual.train(s, window=24, names=["M2"])
    score = residual.hindcast(test, model).selectExpr("sqrt(avg(pow(lsm_predicted_m - height_m, 2))) AS a", "sqrt(avg(pow(combined_predicted_m - height_m, 2))) AS b").first()
    assert score.b < 0.7 * score.a
    ahead = series.timeline(spark, s.groupBy("port").agg({"datetime_ist": "max"}).withColumnRenamed("max(datetime_ist)", "l"), __import__("pyspark.sql.functions", fromlist=["expr"]).expr("l + INTERVAL 1 HOUR"), __import__("pyspark.sql.functions", fromlist=["expr"]).expr("l + INTERVAL 13 HOURS"))
    made = residual.forecast(s, ahead, lsm, model, window=24).orderBy("datetime_ist").collect()
    assert len(made) == 12
    late = ahead.selectExpr("port", "datetime_ist + INTERVAL 5 HOURS AS datetime_ist")
    with pytest.raises(Exception, match="ends before"):
        residual.forecast(s, late, lsm, model, window=24).collect()
    assert residual.forecast(s, late, lsm, model, allow_stale_context=True, window=24).count() == 12
    end = s.selectExpr("max(datetime_ist) AS l").first().l
    for gone in (3, 23):  # a missing hour in the context is an error, however many older rows there are
        with pytest.raises(Exception, match="23 of 24"):
            residual.forecast(s.where(f"datetime_ist <> TIMESTAMP_NTZ '{end - timedelta(hours=gone)}'"), ahead, lsm, model, window=24).collect()
    weights = np.array(model.first().weights)
    base, m = {r.datetime_ist: r.residual for r in residual.with_residuals(s, lsm).collect()}, model.first()
    z = [(base[end - timedelta(hours=k)] - m["mean"]) / m["std"] for k in range(23, -1, -1)]
    for r in made:  # the plain loop
        t = r.datetime_ist
        day, hour = t.timetuple().tm_yday, t.hour
        times = [f(x * 2 * math.pi / p) for x, p in ((hour, 24), (day, 365.25), (t.month, 12)) for f in (math.sin, math.cos)]
        z.append(float(np.dot(z[-24:] + times + [1.0], weights)))
        assert r.residual_predicted_m == pytest.approx(z[-1] * m["std"] + m["mean"], abs=1e-5)


def test_lstm_forward_equals_a_loop():
    r = np.random.default_rng(0)
    h, f = 5, 7
    w = {"w_ih0": r.normal(size=(4 * h, f)), "w_hh0": r.normal(size=(4 * h, h)), "b0": r.normal(size=4 * h), "w_ih1": r.normal(size=(4 * h, h)), "w_hh1": r.normal(size=(4 * h, h)), "b1": r.normal(size=4 * h), "w2": r.normal(size=(1, 3)), "b2": r.normal(size=1)}
    w |= {"w1": r.normal(size=(3, h))}
    x = r.normal(size=(3, 6, f))
    head = {**w, "b1": w["b1"]}

    def cell(x, h0, c0, k):
        gates = [sum(w[f"w_ih{k}"][j, i] * x[i] for i in range(len(x))) + sum(w[f"w_hh{k}"][j, i] * h0[i] for i in range(h)) + w[f"b{k}"][j] for j in range(4 * h)]
        s = lambda v: 1 / (1 + math.exp(-v))
        c = [s(gates[h + j]) * c0[j] + s(gates[j]) * math.tanh(gates[2 * h + j]) for j in range(h)]
        return [s(gates[3 * h + j]) * math.tanh(c[j]) for j in range(h)], c

    outs = []
    for n in range(3):
        state = [([0.0] * h, [0.0] * h) for _ in range(2)]
        for step in x[n]:
            v = list(step)
            for k in range(2):
                state[k] = cell(v, *state[k], k)
                v = state[k][0]
        outs.append(v)
    head["b1"] = w["b1"]
    got = residual.lstm_forward(x, {**head, "head_b1": np.zeros(3)})
    hidden = np.maximum(0.0, np.array(outs) @ w["w1"].T)
    assert got == pytest.approx((hidden @ w["w2"].T + w["b2"])[:, 0])


def test_words_to_hours(spark):
    words = [(1, "3", 10.0, 100.2)] + [(1, f"{h / 10:.1f}", 20.0 + h, 99.6) for h in range(24)] + [(1, "4", 10.0, 130.0), (1, "1.0", 20.0, 130.0)]
    text = "NAME OF PORT:- East Quay (Dock) MONTH SEPT YEAR 2024"
    w = spark.createDataFrame(words, "page int, text string, x0 double, top double")
    got = extraction.hourly_days(w, spark.createDataFrame([(1, text)], "page int, text string")).orderBy("datetime_ist").collect()
    assert len(got) == 24 and got[5].datetime_ist == datetime(2024, 9, 3, 5) and got[5].height_m == 0.5 and got[0].port == "EAST QUAY"


def test_event_table(spark):
    def put(s, x, top, size=7.0):
        return [(1, c, x + 2.0 * k, top, size) for k, c in enumerate(s)]

    chars = put("12", 235.0, 150.0, 10.0) + put("0415", 253.0, 150.5) + put("4.62", 272.0, 150.9) + put("1030", 253.0, 160.0) + put("1.05", 272.0, 160.4) + put("2599", 253.0, 170.0)
    got = extraction.table_events(spark.createDataFrame(chars, "page int, text string, x0 double, top double, size double")).orderBy("time_value").collect()
    assert [(g.day, g.time_value, g.height_m) for g in got] == [(12, "0415", 4.62), (12, "1030", 1.05)]


def test_io(spark, tmp_path):
    s = frame(spark, [1.2345, 2.0, 3.0])
    io.write_csv(s.unionByName(s), str(tmp_path / "h"))
    assert io.read_hourly(spark, str(tmp_path / "h")).count() == 3
    assert io.read_hourly(spark, str(tmp_path / "h"), dedupe=False).count() == 6
    (tmp_path / "first.csv").write_text("port,datetime_ist,height_m\np,2020-01-01 00:00:00,5.0\np,2020-01-01 00:00:00,2.0\np,2020-01-01 01:00:00,1.0\n")
    assert [r.height_m for r in io.read_hourly(spark, str(tmp_path / "first.csv")).orderBy("datetime_ist").collect()] == [5.0, 1.0]
    io.write_hourly(s, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("year = 2020").count() == 3
    (tmp_path / "e.csv").write_text("state,datetime_ist\n high ,2020-01-01 00:00:00\n")
    with pytest.raises(ValueError, match="height_m"):
        io.read_events(spark, str(tmp_path / "e.csv"))


def test_month_names(spark):
    rows = spark.createDataFrame([("SEPT",), ("ma",), ("June",), ("mar",), ("X",), (None,)], "m string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(scalars.month_number(F.col("m"))).collect()] == [9, None, 6, 3, None, None]
