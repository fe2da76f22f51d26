"""Named queries over the driver tables, with equivalent SQL where SQL can express them.

The tables hold no tides. Hourly means of ``events`` per type stand in for observed heights: they have
real gaps. Predicted heights are the hour before (persistence) or the committed-form harmonic terms below.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import extraction, harmonic, metrics, peaks, residual, series, turning
from ..session import ship
from ..sources import io
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A small harmonic model for queries: (name, speed, A, B), and its mean level.
TERMS = (("M2", 28.9841042, -1.6, 0.25), ("S2", 30.0, 0.7, -0.08), ("K1", 15.0410686, 0.1, 0.15), ("O1", 13.9430356, -0.05, 0.06))
LEVEL = 3.3
NAMES = [t[0] for t in TERMS]


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, rows: str = "true") -> DataFrame:
    """Hourly means of the events that ``rows`` keeps, summed by row group where there are several."""
    e = table(spark, sf_dir, "events")
    groups = io.row_groups(e)
    if len(groups) < 2:
        return series.hourly_series(e.where(rows), "event_type", "ts", "value")
    return series.hourly_series(io.with_row_group(e, groups).where(rows), "event_type", "ts", "value", part="row_group")


def persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations beside the hour before as prediction."""
    s = hourly(spark, sf_dir)
    return series.neighbours(s, {"predicted_m": ("height_m", -1)}).where(F.col("predicted_m").isNotNull())


def small_model(spark: SparkSession, ports: list[str] | None = None) -> DataFrame:
    about = {c[0]: c for c in harmonic.CONSTITUENTS}
    rows = [(p, n, about[n][3], about[n][1], w, math.hypot(a, b), math.degrees(math.atan2(b, a)) % 360.0, a, b, LEVEL, 0.0, False) for p in ports or ["model"] for n, w, a, b in TERMS]
    return spark.createDataFrame(rows, harmonic.MODEL_SCHEMA)


_S = "s AS (SELECT event_type AS port, date_trunc('hour', ts)::TIMESTAMP AS datetime_ist, round(avg(value), 6) AS height_m FROM events GROUP BY 1, 2)"
_W = "(PARTITION BY port ORDER BY datetime_ist)"
_P = f"{_S}, p AS (SELECT * FROM (SELECT *, lag(height_m) OVER {_W} AS predicted_m FROM s) WHERE predicted_m IS NOT NULL)"
_TP = f"""{_S}, n AS (SELECT *, lag(height_m) OVER {_W} AS p, lead(height_m) OVER {_W} AS f FROM s),
e AS (SELECT *, CASE WHEN p IS NULL AND height_m > f THEN 'High' WHEN p IS NULL AND height_m < f THEN 'Low' WHEN height_m >= p AND height_m > f THEN 'High' WHEN height_m <= p AND height_m < f THEN 'Low' END AS state,
  (p - 2 * height_m + f) / 2 AS a, (f - p) / 2 AS b FROM n WHERE f IS NOT NULL),
o AS (SELECT *, CASE WHEN a = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, -b / (2 * a))) END AS o FROM e WHERE state IS NOT NULL),
t AS (SELECT port, state, CASE WHEN p IS NULL THEN datetime_ist ELSE datetime_ist + to_milliseconds(CAST(round(o * 3600000) AS BIGINT)) END AS datetime_ist,
  round(CASE WHEN p IS NULL THEN height_m ELSE height_m + b * o + a * o * o END, 4) AS height_m, p IS NULL AS is_boundary_estimate FROM o)"""
_T = "date_diff('second', TIMESTAMP '2000-01-01', datetime_ist) / 3600.0"


@query("hourly_series", f"WITH {_S} SELECT * FROM s")
def hourly_series(spark, sf_dir):
    return hourly(spark, sf_dir)


_DEDUPE = "SELECT port, datetime_ist, height_m FROM (SELECT event_type AS port, date_trunc('hour', ts)::TIMESTAMP AS datetime_ist, value AS height_m, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts {d}, event_id {d}) AS k FROM events) WHERE k = 1"


def _dedupe(spark, sf_dir, keep):
    e = table(spark, sf_dir, "events")
    keys = [F.col("event_type").alias("port"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("datetime_ist")]
    return keep(e, keys, F.col("value"), F.struct("ts", "event_id"))


@query("dedupe_keep_first", _DEDUPE.format(d="ASC"))
def dedupe_keep_first(spark, sf_dir):
    return _dedupe(spark, sf_dir, series.keep_first)


@query("dedupe_last_wins", _DEDUPE.format(d="DESC"))
def dedupe_last_wins(spark, sf_dir):
    return _dedupe(spark, sf_dir, series.keep_last)


@query("t_hours_axis", f"WITH {_S} SELECT port, datetime_ist, {_T} AS t_hours FROM s")
def t_hours_axis(spark, sf_dir):
    return series.with_t_hours(hourly(spark, sf_dir)).select("port", "datetime_ist", "t_hours")


@query("time_range_filter", f"WITH {_S} SELECT * FROM s WHERE datetime_ist >= TIMESTAMP '2024-01-10' AND datetime_ist < TIMESTAMP '2024-01-17' AND port = 'click'")
def time_range_filter(spark, sf_dir):
    # the bounds are whole hours, so they hold for raw rows too and prune the scan before the aggregate
    h = hourly(spark, sf_dir, "event_type = 'click' AND ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-17'")
    return series.time_range(h, "2024-01-10", "2024-01-17")


_BLOCKS = f"""b AS (SELECT port, datetime_ist, sum(gap) OVER (PARTITION BY port ORDER BY datetime_ist ROWS UNBOUNDED PRECEDING)::BIGINT AS block_id FROM
  (SELECT *, CASE WHEN date_diff('minute', lag(datetime_ist) OVER {_W}, datetime_ist) <> 60 THEN 1 ELSE 0 END AS gap FROM s))"""


@query("gap_blocks", f"WITH {_S}, {_BLOCKS} SELECT port, block_id, count(*) AS n_rows, min(datetime_ist) AS first_ts, max(datetime_ist) AS last_ts, count(*) >= 5 AS usable FROM b GROUP BY port, block_id")
def gap_blocks(spark, sf_dir):
    return series.block_summary(hourly(spark, sf_dir))


@query("chronological_split", f"""WITH {_S}, r AS (SELECT *, row_number() OVER {_W} <= floor(count(*) OVER (PARTITION BY port) * 0.9::DOUBLE) AS train FROM s)
SELECT port, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_valid, max(datetime_ist) FILTER (train) AS train_last, min(datetime_ist) FILTER (NOT train) AS valid_first FROM r GROUP BY port""")
def chronological_split(spark, sf_dir):
    return series.split_summary(hourly(spark, sf_dir))


@query("turning_points", f"WITH {_TP} SELECT * FROM t")
def turning_points(spark, sf_dir):
    return turning.turning_points(hourly(spark, sf_dir))


@query("turning_points_bucketed", f"WITH {_TP} SELECT * FROM t")
def turning_points_bucketed(spark, sf_dir):
    return turning.turning_points(hourly(spark, sf_dir), bucket="DAY")


@query("event_frequency", f"""WITH {_TP}, g AS (SELECT *, date_diff('microsecond', lag(datetime_ist) OVER (PARTITION BY port, state ORDER BY datetime_ist), datetime_ist) / 3.6e9 AS gap FROM t),
a AS (SELECT port, state, count(*) AS n, round(avg(gap), 6) AS average_interval_hours, string_agg(strftime(datetime_ist, '%H:%M'), ', ' ORDER BY datetime_ist) AS i, string_agg(strftime(datetime_ist - INTERVAL '5 hours 30 minutes', '%H:%M'), ', ' ORDER BY datetime_ist) AS u FROM g GROUP BY port, state)
SELECT k.port, k.state, coalesce(n, 0) AS count, average_interval_hours, coalesce(i, '') AS event_times_ist, coalesce(u, '') AS event_times_utc
FROM (SELECT DISTINCT port, st.state FROM t, (VALUES ('High'), ('Low')) AS st(state)) k LEFT JOIN a USING (port, state)""")
def event_frequency(spark, sf_dir):
    out = turning.event_frequency(turning.turning_points(hourly(spark, sf_dir)), with_utc=True)
    return out.withColumn("average_interval_hours", F.round("average_interval_hours", 6))


_ANGLE = "date_diff('microsecond', TIMESTAMP '2000-01-07', datetime_ist) / 1e6 / 86400.0 / 29.530588853 * (2 * pi())"
_EW = "(PARTITION BY port ORDER BY datetime_ist)"
_HOUR = "(hour(datetime_ist) + minute(datetime_ist) / 60.0)"
_DAY = "(dayofyear(datetime_ist) + hour(datetime_ist) / 24.0 + minute(datetime_ist) / 1440.0)"


@query("event_features", f"""WITH {_TP}, x AS (SELECT *, coalesce(lag(height_m) OVER {_EW}, height_m) AS ph, coalesce(lead(height_m) OVER {_EW}, height_m) AS fh,
  date_diff('microsecond', lag(datetime_ist) OVER {_EW}, datetime_ist) / 3.6e9 AS pg, date_diff('microsecond', datetime_ist, lead(datetime_ist) OVER {_EW}) / 3.6e9 AS fg FROM t)
SELECT port, state, datetime_ist, CASE WHEN state = 'High' THEN 1.0 ELSE 0.0 END::DOUBLE AS state_high, round(height_m, 6) AS height, round(ph, 6) AS previous_height, round(fh, 6) AS following_height, round(abs(height_m - ph), 6) AS previous_range, round(abs(height_m - fh), 6) AS following_range,
  round(greatest(0, least(24, coalesce(pg, 6))), 7) AS previous_interval, round(greatest(0, least(24, coalesce(fg, 6))), 7) AS following_interval,
  round(sin({_HOUR} * (2 * pi() / 24)), 6) AS hour_sin, round(cos({_HOUR} * (2 * pi() / 24)), 6) AS hour_cos, round(sin({_DAY} * (2 * pi() / 365.25)), 6) AS day_of_year_sin, round(cos({_DAY} * (2 * pi() / 365.25)), 6) AS day_of_year_cos,
  round(sin({_ANGLE}), 6) AS moon_sin, round(cos({_ANGLE}), 6) AS moon_cos, round(sin(2 * {_ANGLE}), 6) AS moon_second_harmonic_sin, round(cos(2 * {_ANGLE}), 6) AS moon_second_harmonic_cos,
  round(date_diff('microsecond', TIMESTAMP '2000-01-01', datetime_ist) / 1e6 / (365.25 * 86400.0), 6) AS elapsed_years FROM x""")
def event_features(spark, sf_dir):
    out = turning.event_features(turning.turning_points(hourly(spark, sf_dir)))
    return out.select("port", "state", "datetime_ist", *[S.round_scaled(F.col(c), 7 if c.endswith("interval") else 6).alias(c) for c in turning.FEATURE_NAMES])


_CYC = ", ".join(f"round({f}({x} * (2 * pi() / {p})), 5) AS {n}_{f}" for n, x, p in (("hour", "hour(datetime_ist)", "24.0"), ("doy", "dayofyear(datetime_ist)", "365.25"), ("month", "month(datetime_ist)", "12.0")) for f in ("sin", "cos"))


@query("residual_time_features", f"WITH {_S} SELECT port, datetime_ist, {_CYC} FROM s")
def residual_time_features(spark, sf_dir):
    out = turning.time_features(hourly(spark, sf_dir).select("port", "datetime_ist"))
    return out.select("port", "datetime_ist", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in residual.TIME_COLUMNS])


_FOUND = "SELECT port, state, date_trunc('millisecond', datetime_ist) AS datetime_ist, round(height_m, 6) AS height_m FROM found"


def _to_millis(df: DataFrame) -> DataFrame:
    """Events with times in whole milliseconds: the last bits of a vertex depend on the order of its sums."""
    return df.withColumn("datetime_ist", F.date_trunc("MILLISECOND", "datetime_ist").cast("timestamp_ntz")).withColumn("height_m", F.round("height_m", 6))


@query("prominent_events", f"WITH RECURSIVE {_S}, {oracles.peaks('s', 60, 4, peaks.PROMINENCE_M)} {_FOUND}")
def prominent_events(spark, sf_dir):
    return _to_millis(peaks.prominent_events(hourly(spark, sf_dir)))


_OBS = "t AS MATERIALIZED (SELECT * FROM t0), o0 AS (SELECT 'pair' AS port, state, datetime_ist, height_m FROM t WHERE port = 'purchase'), p0 AS (SELECT 'pair' AS port, state, datetime_ist, height_m FROM t WHERE port = 'click')"
_SIDES = _TP.replace("\nt AS (", "\nt0 AS (") + ", " + _OBS


def _purchase_click(spark, sf_dir):
    t = turning.turning_points(hourly(spark, sf_dir))
    side = lambda kind: t.where(F.col("port") == kind).withColumn("port", F.lit("pair"))
    return side("purchase"), side("click")


@query("greedy_match", f"WITH RECURSIVE {_SIDES}, {oracles.matched('o0', 'p0', peaks.MATCH_MINUTES * 60_000_000)} SELECT * FROM pairs")
def greedy_match(spark, sf_dir):
    return peaks.match_events(*_purchase_click(spark, sf_dir))


@query("greedy_match_unbounded", f"WITH RECURSIVE {_SIDES}, {oracles.matched('o0', 'p0', None)} SELECT * FROM pairs")
def greedy_match_unbounded(spark, sf_dir):
    return peaks.match_events(*_purchase_click(spark, sf_dir), max_minutes=None)


_NH = f"""{_TP}, c AS (SELECT t.port, t.state, t.datetime_ist AS ev, s.datetime_ist, abs(date_diff('microsecond', t.datetime_ist, s.datetime_ist)) AS d FROM t JOIN s ON s.port = t.port AND s.datetime_ist BETWEEN t.datetime_ist - INTERVAL '1 hour' AND t.datetime_ist + INTERVAL '1 hour'
  AND s.datetime_ist IN (date_trunc('hour', t.datetime_ist), date_trunc('hour', t.datetime_ist) + INTERVAL '1 hour')),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY port, state, ev ORDER BY d, datetime_ist) = 1),
tag AS (SELECT port, datetime_ist, state AS tide_state FROM best QUALIFY row_number() OVER (PARTITION BY port, datetime_ist ORDER BY ev DESC, state DESC) = 1)"""


@query("nearest_hour_tag", f"WITH {_NH} SELECT s.port, s.datetime_ist, s.height_m, coalesce(tide_state, '') AS tide_state FROM s LEFT JOIN tag USING (port, datetime_ist)")
def nearest_hour_tag(spark, sf_dir):
    h = hourly(spark, sf_dir)
    return turning.nearest_hour_tags(h, turning.turning_points(h)).select("port", "datetime_ist", "height_m", "tide_state")


_PAIRS = f"""{_TP}, k AS (SELECT *, row_number() OVER (PARTITION BY port, state ORDER BY datetime_ist) AS k FROM t),
m AS (SELECT 'pair' AS port, a.state, date_diff('microsecond', a.datetime_ist, b.datetime_ist) / 6e7 AS dt, b.height_m - a.height_m AS dh FROM k a JOIN k b ON a.state = b.state AND a.k = b.k WHERE a.port = 'purchase' AND b.port = 'click' AND abs(date_diff('microsecond', a.datetime_ist, b.datetime_ist)) <= 10800000000)"""


def _pairs(spark, sf_dir):
    """Fixed pairs: the k-th event of each state, where they lie within the limit."""
    t = turning.turning_points(hourly(spark, sf_dir)).withColumn("k", F.row_number().over(Window.partitionBy("port", "state").orderBy("datetime_ist")))
    a = t.where("port = 'purchase'").select("state", "k", F.col("datetime_ist").alias("o"), F.col("height_m").alias("oh"))
    b = t.where("port = 'click'").select("state", "k", F.col("datetime_ist").alias("p"), F.col("height_m").alias("ph"))
    m = a.join(b, ["state", "k"]).select(F.lit("pair").alias("port"), (S.micros_between(F.col("o"), F.col("p")) / 6e7).alias("time_error_minutes"), (F.col("ph") - F.col("oh")).alias("height_error_m"))
    return t, m.where(F.abs("time_error_minutes") <= 180)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("event_error_metrics", f"""WITH {_PAIRS}, c AS (SELECT count(*) AS n FROM t WHERE port = 'purchase'),
a AS (SELECT count(*) AS k, avg(abs(dt)) AS tm, sqrt(avg(dt * dt)) AS tr, avg(abs(dh)) AS hm, sqrt(avg(dh * dh)) AS hr, count(*) FILTER (abs(dt) <= 30) AS t1, count(*) FILTER (abs(dh) <= 0.3) AS h1, count(*) FILTER (abs(dt) <= 30 AND abs(dh) <= 0.3) AS j1 FROM m)
SELECT 'pair' AS port, n AS observed_events, k AS matched_events, round(100.0 * k / n, 6) AS match_rate_percent, round(tm, 6) AS time_mae_minutes, round(tr, 6) AS time_rmse_minutes, round(hm, 6) AS height_mae_m, round(hr, 6) AS height_rmse_m,
  round(100.0 * t1 / n, 6) AS timing_accuracy_percent, round(100.0 * h1 / n, 6) AS height_accuracy_percent, round(100.0 * j1 / n, 6) AS joint_accuracy_percent, 100.0 * t1 / n >= 95 AS timing_pass, 100.0 * h1 / n >= 95 AS height_pass, 100.0 * j1 / n >= 95 AS joint_pass FROM a, c""")
def event_error_metrics(spark, sf_dir):
    t, m = _pairs(spark, sf_dir)
    observed = t.where("port = 'purchase'").groupBy(F.lit("pair").alias("port")).agg(F.count("*").alias("observed_events"))
    return _rounded(metrics.event_errors(m, observed))


@query("report_error_metrics", f"WITH {_PAIRS} SELECT port, count(*) AS matched_events, round(avg(abs(dt)), 6) AS time_mae_minutes, round(sqrt(avg(dt * dt)), 6) AS time_rmse_minutes, round(avg(abs(dh)), 6) AS height_mae_m, round(sqrt(avg(dh * dh)), 6) AS height_rmse_m, round(avg(dh), 6) AS height_bias_m FROM m GROUP BY port")
def report_error_metrics(spark, sf_dir):
    return _rounded(metrics.report_errors(_pairs(spark, sf_dir)[1]))


@query("forecast_obs_join", f"WITH {_S} SELECT a.port, a.datetime_ist, a.height_m, b.height_m AS predicted_m, round(b.height_m - a.height_m, 6) AS residual_m FROM s a JOIN s b ON a.port = b.port AND b.datetime_ist = a.datetime_ist - INTERVAL '24 hours'")
def forecast_obs_join(spark, sf_dir):
    s = hourly(spark, sf_dir)
    fc = s.select("port", (F.col("datetime_ist") + F.expr("INTERVAL 24 HOURS")).alias("datetime_ist"), F.col("height_m").alias("predicted_m"))
    return s.join(fc, ["port", "datetime_ist"]).withColumn("residual_m", F.round(F.col("predicted_m") - F.col("height_m"), 6))


_SKILL = """count(*) AS n, round(avg(predicted_m - height_m), 6) AS bias_m, round(sqrt(avg((predicted_m - height_m) * (predicted_m - height_m))), 6) AS rmse_m,
  round(CASE WHEN var_pop(predicted_m) > 0 AND var_pop(height_m) > 0 THEN covar_pop(predicted_m, height_m) / (stddev_pop(predicted_m) * stddev_pop(height_m)) END, 6) AS r,
  round(CASE WHEN sum(height_m * height_m) <> 0 THEN sqrt(sum(predicted_m * predicted_m) / sum(height_m * height_m)) END, 6) AS sr"""


@query("skill_metrics", f"WITH {_P} SELECT port, {_SKILL} FROM p GROUP BY port")
def skill_metrics(spark, sf_dir):
    return _rounded(metrics.skill_metrics(persisted(spark, sf_dir), "height_m", "predicted_m", ["port"]))


@query("horizon_metrics", f"WITH {_P}, q AS (SELECT *, row_number() OVER {_W} AS rn FROM p) SELECT port, horizon, {_SKILL} FROM q JOIN (VALUES (6), (12), (24), (48), (72)) AS h(horizon) ON rn <= horizon GROUP BY port, horizon HAVING count(*) >= horizon")
def horizon_metrics(spark, sf_dir):
    return _rounded(metrics.horizon_metrics(persisted(spark, sf_dir), "height_m", "predicted_m", ["port"], "datetime_ist"))


@query("rmse_improvement", f"""WITH {_P}, q AS (SELECT port, sqrt(avg((predicted_m - height_m) * (predicted_m - height_m))) AS a, stddev_pop(height_m) AS b FROM p GROUP BY port)
SELECT port, round(b, 6) AS mean_rmse_m, round(a, 6) AS model_rmse_m, round(CASE WHEN b <> 0 THEN 100 * (b - a) / b END, 6) AS improvement_percent FROM q""")
def rmse_improvement(spark, sf_dir):
    q = persisted(spark, sf_dir).groupBy("port").agg(F.sqrt(F.avg(F.pow(F.col("predicted_m") - F.col("height_m"), 2))).alias("a"), F.stddev_pop("height_m").alias("b"))
    return _rounded(q.select("port", F.col("b").alias("mean_rmse_m"), F.col("a").alias("model_rmse_m"), metrics.improvement_percent(F.col("b"), F.col("a")).alias("improvement_percent")))


def _sql_angle(speed):
    return f"radians({speed!r}::DOUBLE) * ({_T})"


_DESIGN = ", ".join(f"{f}({_sql_angle(w)}) AS {f}_{n}" for n, w, _, _ in TERMS for f in ("cos", "sin"))


@query("harmonic_design", f"WITH {_S} SELECT port, datetime_ist, {', '.join(f'round({f}({_sql_angle(w)}), 6) AS {f}_{n}' for n, w, _, _ in TERMS for f in ('cos', 'sin'))} FROM s")
def harmonic_design(spark, sf_dir):
    s = hourly(spark, sf_dir)
    return _rounded(s.select("port", "datetime_ist", *harmonic.design(S.hours_since(F.col("datetime_ist")), NAMES)))


_COLS = ["1.0", *(f"{f}_{n}" for n, *_ in TERMS for f in ("cos", "sin")), "height_m"]
_GRAM_CELLS = ", ".join(f"({i}, {j}, {a} * {b})" for i, a in enumerate(_COLS) for j, b in enumerate(_COLS) if i <= j)


def _untied(x):
    """Rounded to 4 places, off the ties that sums of 6-place heights would hit (a sum's last bits depend on its order)."""
    return F.round(x + 1.234567e-5, 4)


@query("harmonic_gram", f"WITH {_S}, d AS (SELECT port, height_m, {_DESIGN} FROM s) SELECT port, i, j, round(sum(x) + 1.234567e-5, 4) AS s FROM d, LATERAL (VALUES {_GRAM_CELLS}) AS c(i, j, x) GROUP BY port, i, j")
def harmonic_gram(spark, sf_dir):
    return harmonic.gram_sql(hourly(spark, sf_dir), NAMES).withColumn("s", _untied(F.col("s")))


@query("harmonic_gram_partial", f"WITH {_S}, d AS (SELECT port, height_m, {_DESIGN} FROM s) SELECT port, i, j, round(sum(x) + 1.234567e-5, 4) AS s FROM d, LATERAL (VALUES {_GRAM_CELLS}) AS c(i, j, x) GROUP BY port, i, j")
def harmonic_gram_partial(spark, sf_dir):
    return harmonic.gram(hourly(spark, sf_dir), NAMES).where("i <= j").withColumn("s", _untied(F.col("s")))


def _cramer() -> str:
    m = [["n", "c", "s"], ["c", "cc", "cs"], ["s", "cs", "ss"]]
    y = ["y", "cy", "sy"]
    det = lambda a: f"({a[0][0]}*({a[1][1]}*{a[2][2]}-{a[1][2]}*{a[2][1]})-{a[0][1]}*({a[1][0]}*{a[2][2]}-{a[1][2]}*{a[2][0]})+{a[0][2]}*({a[1][0]}*{a[2][1]}-{a[1][1]}*{a[2][0]}))"
    put = lambda k: [[y[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    x = [f"{det(put(k))}/{det(m)}" for k in range(3)]
    ang = _sql_angle(28.9841042)
    return f"""WITH {_S}, d AS (SELECT port, cos({ang}) AS a, sin({ang}) AS b, height_m AS h FROM s),
g AS (SELECT port, count(*)::DOUBLE AS n, sum(a) AS c, sum(b) AS s, sum(a*a) AS cc, sum(a*b) AS cs, sum(b*b) AS ss, sum(h) AS y, sum(a*h) AS cy, sum(b*h) AS sy FROM d GROUP BY port),
x AS (SELECT port, {x[0]} AS h0, {x[1]} AS ca, {x[2]} AS sb FROM g)
SELECT port, 'M2' AS name, round(h0, 5) AS mean_level_m, round(ca, 5) AS A_cos, round(sb, 5) AS B_sin, round(sqrt(ca*ca + sb*sb), 5) AS amplitude_m FROM x"""


@query("harmonic_fit_1", _cramer())
def harmonic_fit_1(spark, sf_dir):
    m = harmonic.fit(hourly(spark, sf_dir), ["M2"])
    return m.select("port", "name", *[F.round(c, 5).alias(c) for c in ("mean_level_m", "A_cos", "B_sin", "amplitude_m")])


_ALL = ", ".join(f"({k}, '{n}', {harmonic.SPEEDS[n]!r}::DOUBLE)" for k, n in enumerate(harmonic.SPEEDS, 1))
_ROUNDED_MODEL = "round(w[1], 4) AS mean_level_m, round(w[2 * k], 4) AS A_cos, round(w[2 * k + 1], 4) AS B_sin, round(sqrt(w[2 * k] * w[2 * k] + w[2 * k + 1] * w[2 * k + 1]), 4) AS amplitude_m"


@query("harmonic_fit_full", f"""WITH RECURSIVE {_S}, con AS (SELECT * FROM (VALUES {_ALL}) AS c(ord, name, speed)),
kp AS (SELECT port, date_diff('second', min(datetime_ist), max(datetime_ist)) / 3600.0 + 1 AS span, 0 AS k, []::DOUBLE[] AS kept, []::VARCHAR[] AS names FROM s GROUP BY port UNION ALL
  SELECT port, span, ord, CASE WHEN ok THEN list_append(kept, speed) ELSE kept END, CASE WHEN ok THEN list_append(names, name) ELSE names END FROM
    (SELECT kp.*, con.*, span * speed >= 360 AND len(list_filter(kept, lambda x: span * abs(speed - x) < 360)) = 0 AS ok FROM kp JOIN con ON ord = k + 1)),
last AS (SELECT port, kept, names FROM kp WHERE k = {len(harmonic.SPEEDS)}),
d AS (SELECT port, datetime_ist AS ts, list_concat([1.0::DOUBLE], flatten(list_transform(kept, lambda w: [cos(radians(w) * {_T}), sin(radians(w) * {_T})])), [height_m]) AS c FROM s JOIN last USING (port)),
{oracles.gram('d')}, {oracles.eliminated('g')}
SELECT port, names[k] AS name, {_ROUNDED_MODEL} FROM x JOIN last USING (port), LATERAL (SELECT unnest(range(1, len(names) + 1)) AS k) AS u""")
def harmonic_fit_full(spark, sf_dir):
    m = harmonic.fit(hourly(spark, sf_dir), rayleigh=True)
    return m.select("port", "name", *[F.round(c, 4).alias(c) for c in ("mean_level_m", "A_cos", "B_sin", "amplitude_m")])


def _sql_nodal(name: str) -> tuple[str, str]:
    """(factor, shift) of a constituent at hours _T."""
    if name not in harmonic.NODAL_SERIES:
        return "1.0", "0.0"
    f, u, power = harmonic.NODAL_SERIES[name]
    n = f"radians({harmonic.NODE_AT_EPOCH!r}::DOUBLE - {harmonic.NODE_PER_DAY!r}::DOUBLE * (({_T}) / 24.0 - 0.5))"
    return f"pow({' + '.join(f'({c!r}::DOUBLE) * cos({k} * {n})' for k, c in enumerate(f))}, {power})", f"radians({' + '.join(f'({c!r}::DOUBLE) * sin({k} * {n})' for k, c in enumerate(u))})"


_NODAL_COLUMNS = ", ".join(f"{_sql_nodal(n)[0]} * {f}({_sql_angle(w)} + {_sql_nodal(n)[1]})" for n, w, _, _ in TERMS for f in ("cos", "sin"))


@query("harmonic_fit_nodal", f"""WITH RECURSIVE {_S}, d AS (SELECT port, datetime_ist AS ts, [1.0::DOUBLE, {_NODAL_COLUMNS}, height_m] AS c FROM s), {oracles.gram('d')}, {oracles.eliminated('g')}
SELECT port, ({NAMES!r})[k] AS name, {_ROUNDED_MODEL} FROM x, (VALUES {", ".join(f"({k})" for k in range(1, len(NAMES) + 1))}) AS u(k)""")
def harmonic_fit_nodal(spark, sf_dir):
    m = harmonic.fit(hourly(spark, sf_dir), NAMES, nodal=True)
    return m.select("port", "name", *[F.round(c, 4).alias(c) for c in ("mean_level_m", "A_cos", "B_sin", "amplitude_m")])


_PRED = f"{LEVEL!r}" + "".join(f" + ({a!r}) * cos({_sql_angle(w)}) + ({b!r}) * sin({_sql_angle(w)})" for _, w, a, b in TERMS)


@query("harmonic_predict", f"WITH {_S} SELECT port, datetime_ist, round({_PRED}, 6) AS predicted_m FROM s")
def harmonic_predict(spark, sf_dir):
    s = hourly(spark, sf_dir)
    t = S.hours_since(F.col("datetime_ist"))
    return s.select("port", "datetime_ist", F.round(harmonic.predict_expr(t, LEVEL, [x[1:] for x in TERMS]), 6).alias("predicted_m"))


_PORTS = ["click", "error", "purchase", "signup", "view"]


@query("harmonic_predict_join", f"WITH {_S} SELECT port, datetime_ist, round({_PRED}, 6) AS predicted_m FROM s")
def harmonic_predict_join(spark, sf_dir):
    s = hourly(spark, sf_dir)
    return harmonic.predict(s, small_model(spark, _PORTS)).select("port", "datetime_ist", F.round("predicted_m", 6).alias("predicted_m"))


_NODAL = f"{LEVEL!r}" + "".join(f" + {_sql_nodal(n)[0]} * (({a!r}) * cos({_sql_angle(w)} + {_sql_nodal(n)[1]}) + ({b!r}) * sin({_sql_angle(w)} + {_sql_nodal(n)[1]}))" for n, w, a, b in TERMS)


@query("harmonic_predict_nodal", f"WITH {_S} SELECT port, datetime_ist, round({_NODAL}, 6) AS predicted_m FROM s")
def harmonic_predict_nodal(spark, sf_dir):
    model = small_model(spark, _PORTS).withColumn("nodal", F.lit(True))
    return harmonic.predict(hourly(spark, sf_dir), model).select("port", "datetime_ist", F.round("predicted_m", 6).alias("predicted_m"))


_MODEL = ", ".join(f"('{n}', {w!r}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE)" for n, w, a, b in TERMS)


@query("harmonic_amp_phase", f"SELECT name, round(sqrt(a*a + b*b), 6) AS amplitude_m, round(CASE WHEN degrees(atan2(b, a)) < 0 THEN degrees(atan2(b, a)) + 360 ELSE degrees(atan2(b, a)) END, 6) AS phase_deg FROM (VALUES {_MODEL}) AS m(name, w, a, b)")
def harmonic_amp_phase(spark, sf_dir):
    amp, phase = harmonic.amp_phase(F.col("A_cos"), F.col("B_sin"))
    return small_model(spark).select("name", F.round(amp, 6).alias("amplitude_m"), F.round(phase, 6).alias("phase_deg"))


@query("top_amplitudes", f"SELECT name, round(sqrt(a*a + b*b), 6) AS amplitude_m FROM (VALUES {_MODEL}) AS m(name, w, a, b) ORDER BY amplitude_m DESC LIMIT 3")
def top_amplitudes(spark, sf_dir):
    return small_model(spark).select("name", F.round("amplitude_m", 6).alias("amplitude_m")).orderBy(F.desc("amplitude_m")).limit(3)


_DAYS = f"{_S}, e AS (SELECT port, CAST(floor(({_T}) / 24) AS BIGINT) AS day, max(height_m) AS high, min(height_m) AS low FROM s GROUP BY 1, 2)"


@query("daily_extrema", f"WITH {_DAYS} SELECT * FROM e")
def daily_extrema(spark, sf_dir):
    return harmonic.daily_extrema(hourly(spark, sf_dir)).select("port", "day", "high", "low")


@query("tidal_datums", f"""WITH {_DAYS}, q AS (SELECT port, quantile_cont(high, 0.9) AS hi, quantile_cont(low, 0.1) AS lo FROM e GROUP BY port),
a AS (SELECT port, max(high) AS hat, avg(high) AS mhw, avg(low) AS mlw, min(low) AS lat, avg(high) FILTER (high >= hi) AS mhws, avg(low) FILTER (low <= lo) AS mlws FROM e JOIN q USING (port) GROUP BY port)
SELECT port, round(hat, 6) AS HAT, round(mhws, 6) AS MHWS, round(mhw, 6) AS MHW, round(msl, 6) AS MSL, round(mlw, 6) AS MLW, round(mlws, 6) AS MLWS, round(lat, 6) AS LAT, round(hat - lat, 6) AS RA FROM a JOIN (SELECT port, avg(height_m) AS msl FROM s GROUP BY port) USING (port)""")
def tidal_datums(spark, sf_dir):
    return _rounded(harmonic.datums(hourly(spark, sf_dir)))


@query("forecast_timeline", f"WITH {_S} SELECT port, unnest(generate_series(l + INTERVAL '1 hour', l + INTERVAL '72 hours', INTERVAL '1 hour')) AS datetime_ist FROM (SELECT port, max(datetime_ist) AS l FROM s GROUP BY port)")
def forecast_timeline(spark, sf_dir):
    last = hourly(spark, sf_dir).groupBy("port").agg(F.max("datetime_ist").alias("l"))
    return series.timeline(spark, last, F.col("l") + F.expr("INTERVAL 1 HOUR"), F.col("l") + F.expr("INTERVAL 73 HOURS"))


@query("ist_to_utc", f"WITH {_S} SELECT port, datetime_ist, datetime_ist - INTERVAL '5 hours 30 minutes' AS datetime_utc FROM s")
def ist_to_utc(spark, sf_dir):
    return hourly(spark, sf_dir).select("port", "datetime_ist", S.to_utc(F.col("datetime_ist")).alias("datetime_utc"))


@query("residual_scaler", f"""WITH {_P}, q AS (SELECT port, height_m - predicted_m AS r, row_number() OVER {_W} AS rn, count(*) OVER (PARTITION BY port) AS n FROM p)
SELECT port, round(avg(r), 6) AS mean, round(stddev_pop(r) + 1e-8, 6) AS std FROM q WHERE rn <= floor(n * 0.8::DOUBLE) GROUP BY port""")
def residual_scaler(spark, sf_dir):
    p = persisted(spark, sf_dir).withColumn("residual", F.col("height_m") - F.col("predicted_m"))
    return _rounded(residual.scaler(p))


@query("residual_stats", f"WITH {_P} SELECT port, round(avg(height_m - predicted_m), 6) AS mean, round(stddev_pop(height_m - predicted_m), 6) AS std, round(max(abs(height_m - predicted_m)), 6) AS max_abs FROM p GROUP BY port")
def residual_stats(spark, sf_dir):
    p = persisted(spark, sf_dir).withColumn("residual", F.col("height_m") - F.col("predicted_m"))
    return _rounded(residual.residual_stats(p))


@query("sliding_windows", f"""WITH {_S}, w AS (SELECT port, datetime_ist, height_m, row_number() OVER {_W} AS rn, list(height_m) OVER (PARTITION BY port ORDER BY datetime_ist ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS win FROM s)
SELECT port, datetime_ist, height_m AS target_m, len(win) AS n, round(list_sum(win), 4) AS window_sum, win[1] AS first_m, win[168] AS last_m FROM w WHERE rn > 168""")
def sliding_windows(spark, sf_dir):
    w = series.sliding_windows(hourly(spark, sf_dir))
    total = F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 4)
    return w.select("port", "datetime_ist", F.col("height_m").alias("target_m"), F.size("window").cast("long").alias("n"), total.alias("window_sum"), F.col("window")[0].alias("first_m"), F.col("window")[167].alias("last_m"))


@query("state_alternation", f"""WITH {_TP}, a AS (SELECT port, datetime_ist, height_m, CASE WHEN height_m > coalesce(lag(height_m) OVER {_EW}, lead(height_m) OVER {_EW}) THEN 'High' ELSE 'Low' END AS state FROM t)
SELECT *, coalesce(lag(state) OVER {_EW} = state, false) AS breaks FROM a""")
def state_alternation(spark, sf_dir):
    t = turning.turning_points(hourly(spark, sf_dir)).select("port", "datetime_ist", "height_m")
    return turning.alternate_states(t).select("port", "datetime_ist", "height_m", "state", "breaks")


_GRID = "SELECT l_orderkey % 50 AS page, l_orderkey, CAST(round_even(l_extendedprice / 100.0 / 3.0, 0) * 3.0 AS DOUBLE) AS row_y, l_quantity AS x0 FROM lineitem"


@query("row_clusters", f"SELECT page, row_y, count(*) AS n_words, min(x0) AS first_x, max(x0) AS last_x FROM ({_GRID}) GROUP BY page, row_y")
def row_clusters(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_extendedprice") / 100.0).alias("top"))
    return extraction.grid_rows(words).groupBy("page", "row_y").agg(F.count("*").alias("n_words"), F.min("x0").alias("first_x"), F.max("x0").alias("last_x"))


@query("complete_rows", f"SELECT page, row_y, count(*) AS n_words FROM ({_GRID}) GROUP BY page, row_y HAVING count(*) = 4")
def complete_rows(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), (F.col("l_extendedprice") / 100.0).alias("top"))
    return extraction.grid_rows(words).groupBy("page", "row_y").agg(F.count("*").alias("n_words")).where("n_words = 4")


@query("port_name_normalise", r"SELECT p_partkey, trim(regexp_replace(upper(trim(p_name || ' (' || p_brand || ') x')), '\s*\([^)]*\)\s*', '', 'g')) AS port FROM part")
def port_name_normalise(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") x"))
    return table(spark, sf_dir, "part").select("p_partkey", S.port_name(raw).alias("port"))


_MONTH_SQL = "CASE " + " ".join(f"WHEN length(m) >= 3 AND starts_with('{n}', m) THEN {k}" for k, n in enumerate(S.MONTH_NAMES, 1)) + " END"


@query("header_regex", rf"""WITH h AS (SELECT o_orderkey, 'NAME OF PORT:- Port ' || (o_custkey % 7) || ' (Dock) MONTH ' || substr(upper(monthname(o_orderdate)), 1, 3 + (o_orderkey % 4)::INT) || ' YEAR ' || year(o_orderdate) AS t FROM orders),
x AS (SELECT o_orderkey, regexp_extract(t, '(?i)NAME OF PORT:-\s*([A-Z][A-Za-z0-9 ()\-]+?)\s+MONTH\s+([A-Za-z]+)\s+YEAR\s+(\d{{4}})', ['p', 'm', 'y']) AS f FROM h),
y AS (SELECT o_orderkey, f.p AS p, upper(f.m) AS m, f.y AS y FROM x)
SELECT o_orderkey, trim(regexp_replace(upper(trim(p)), '\s*\([^)]*\)\s*', '', 'g')) AS port, ({_MONTH_SQL})::INT AS month, y::INT AS year FROM y""")
def header_regex(spark, sf_dir):
    month = F.upper(F.date_format("o_orderdate", "MMMM"))
    cut = month.substr(F.lit(1), (3 + F.col("o_orderkey") % 4).cast("int"))
    text = F.concat(F.lit("NAME OF PORT:- Port "), (F.col("o_custkey") % 7).cast("string"), F.lit(" (Dock) MONTH "), cut, F.lit(" YEAR "), F.year("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.header_fields(text).alias("h")).select("o_orderkey", "h.port", "h.month", "h.year")


_ERR = f"{_P}, x AS (SELECT port, predicted_m - height_m AS e FROM p)"


@query("error_histogram", f"""WITH {_ERR}, g AS (SELECT min(e) AS lo, max(e) AS hi FROM x)
SELECT port, bin, count(*) AS n FROM (SELECT port, CASE WHEN hi > lo THEN least(79, floor((e - lo) / ((hi - lo) / 80)))::INT ELSE 0 END AS bin FROM x, g) GROUP BY port, bin""")
def error_histogram(spark, sf_dir):
    e = persisted(spark, sf_dir).select("port", (F.col("predicted_m") - F.col("height_m")).alias("e"))
    return metrics.histogram(e, "e", "port")


@query("error_box", f"""WITH {_ERR}, q AS (SELECT port, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3 FROM x GROUP BY port)
SELECT port, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(e) FILTER (e >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(e) FILTER (e <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high FROM x JOIN q USING (port) GROUP BY port, q1, median, q3""")
def error_box(spark, sf_dir):
    e = persisted(spark, sf_dir).select("port", (F.col("predicted_m") - F.col("height_m")).alias("e"))
    return _rounded(metrics.box_stats(e, "e", "port"))


@query("summary_upsert", f"""WITH {_S}, o AS (SELECT port, count(*) AS n, 'old' AS version FROM s GROUP BY port), w AS (SELECT port, count(*) AS n, 'new' AS version FROM s WHERE port IN ('click', 'purchase') GROUP BY port)
SELECT * FROM o WHERE port NOT IN (SELECT port FROM w) UNION ALL SELECT * FROM w""")
def summary_upsert(spark, sf_dir):
    from ..sources.io import upsert

    s = hourly(spark, sf_dir)
    old = s.groupBy("port").agg(F.count("*").alias("n")).withColumn("version", F.lit("old"))
    new = s.where(F.col("port").isin("click", "purchase")).groupBy("port").agg(F.count("*").alias("n")).withColumn("version", F.lit("new"))
    return upsert(old, new, ["port"])


@query("daily_event_counts", f"WITH {_TP} SELECT port, CAST(datetime_ist AS DATE) AS day, count(*) AS n, count(*) BETWEEN 3 AND 5 AS usual FROM t GROUP BY 1, 2")
def daily_event_counts(spark, sf_dir):
    t = turning.turning_points(hourly(spark, sf_dir))
    return t.groupBy("port", F.to_date("datetime_ist").alias("day")).agg(F.count("*").alias("n")).withColumn("usual", F.col("n").between(3, 5))


@query("duplicate_event_times", "SELECT event_type AS port, date_trunc('hour', ts)::TIMESTAMP AS datetime_ist, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_event_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("port"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("datetime_ist"))
    return extraction.duplicate_times(e)


_W = residual.WINDOW
_TIMES = ", ".join(f"{f}({x} * (2 * pi() / {p}))::FLOAT::DOUBLE" for x, p in (("hour(datetime_ist)", "24.0"), ("dayofyear(datetime_ist)", "365.25"), ("month(datetime_ist)", "12.0")) for f in ("sin", "cos"))
_LSM = f"hw[1] + {' + '.join(f'hw[{2 * k}] * cos({_sql_angle(w)}) + hw[{2 * k + 1}] * sin({_sql_angle(w)})' for k, (_, w, _, _) in enumerate(TERMS, 1))}"
#: Gaps carried forward, split, harmonic fit and residual fit on the first 80 %, as common table expressions.
_RESIDUAL = f"""{_S}, span AS (SELECT port, unnest(generate_series(min(datetime_ist), max(datetime_ist), INTERVAL '1 hour')) AS datetime_ist FROM s GROUP BY port),
fs AS (SELECT port, datetime_ist, last_value(height_m IGNORE NULLS) OVER (PARTITION BY port ORDER BY datetime_ist) AS height_m FROM span LEFT JOIN s USING (port, datetime_ist)),
sp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY port ORDER BY datetime_ist) AS rn, count(*) OVER (PARTITION BY port) AS n FROM fs),
hd AS (SELECT port, datetime_ist AS ts, [1.0::DOUBLE, {', '.join(f'{f}({_sql_angle(w)})' for _, w, _, _ in TERMS for f in ('cos', 'sin'))}, height_m] AS c FROM sp WHERE rn <= floor(n * 0.8::DOUBLE)),
{oracles.gram('hd', 'hg')}, {oracles.eliminated('hg', 'hx')}, hm AS (SELECT port, w AS hw FROM hx),
re AS MATERIALIZED (SELECT sp.*, {_LSM} AS lsm, height_m - ({_LSM}) AS residual FROM sp JOIN hm USING (port)),
sc AS (SELECT port, avg(residual) AS mean, stddev_pop(residual) + 1e-8 AS std FROM re WHERE rn <= floor(n * 0.8::DOUBLE) GROUP BY port),
zz AS MATERIALIZED (SELECT *, list(z) OVER (PARTITION BY port ORDER BY datetime_ist ROWS BETWEEN {_W} PRECEDING AND 1 PRECEDING) AS lags, [{_TIMES}, 1.0::DOUBLE] AS times FROM (SELECT re.*, mean, std, (residual - mean) / std AS z FROM re JOIN sc USING (port))),
rd AS (SELECT port, datetime_ist AS ts, list_concat(lags, times, [z]) AS c FROM zz WHERE rn > {_W} AND rn <= floor(n * 0.8::DOUBLE)),
{oracles.gram('rd', 'rg0')}, rg AS (SELECT port, list_transform(m, lambda row, i: list_transform(row, lambda v, j: CASE WHEN i = j THEN v + 1e-3 * greatest(1.0, m[{_W + 7}][{_W + 7}]) ELSE v END)) AS m FROM rg0),
{oracles.eliminated('rg', 'rx')}"""


def _filled(spark, sf_dir):
    return series.carry_forward(hourly(spark, sf_dir))


@query("residual_hindcast", f"""WITH RECURSIVE {_RESIDUAL} SELECT port, datetime_ist, height_m, round(lsm, 4) AS lsm_predicted_m, round(list_dot_product(list_concat(lags, times), w) * std + mean, 4) AS residual_predicted_m
FROM zz JOIN rx USING (port) WHERE rn > {_W} AND rn > floor(n * 0.9::DOUBLE)""")
def residual_hindcast(spark, sf_dir):
    _, model, test = residual.train(_filled(spark, sf_dir), names=NAMES)
    rows = residual.hindcast(test, model)
    return rows.select("port", "datetime_ist", "height_m", *[F.round(c, 4).alias(c) for c in ("lsm_predicted_m", "residual_predicted_m")])


@query("residual_forecast", f"""WITH RECURSIVE {_RESIDUAL}, en AS (SELECT port, max(datetime_ist) AS l FROM fs GROUP BY port),
st AS (SELECT zz.port, any_value(mean) AS mean, any_value(std) AS std, any_value(w) AS w, list(z ORDER BY datetime_ist) AS zs, any_value(l) AS l FROM zz JOIN rx USING (port) JOIN en USING (port) WHERE datetime_ist > l - INTERVAL '{_W} hours' GROUP BY zz.port),
fc AS (SELECT port, mean, std, w, l, 0 AS k, zs, l AS datetime_ist, NULL::DOUBLE AS z FROM st UNION ALL
  SELECT port, mean, std, w, l, k + 1, list_append(zs[2:], step), datetime_ist, step FROM (SELECT port, mean, std, w, l, k, zs, datetime_ist, list_dot_product(list_concat(zs, [{_TIMES}, 1.0::DOUBLE]), w) AS step FROM
    (SELECT port, mean, std, w, l, k, zs, l + to_hours(k + 1) AS datetime_ist FROM fc WHERE k < 24)))
SELECT port, datetime_ist, round({_LSM}, 4) AS lsm_predicted_m, round(z * std + mean, 4) AS residual_predicted_m FROM fc JOIN hm USING (port) WHERE k > 0""")
def residual_forecast(spark, sf_dir):
    s = _filled(spark, sf_dir)
    lsm, model, _ = residual.train(s, names=NAMES)
    last = s.groupBy("port").agg(F.max("datetime_ist").alias("l"))
    ahead = series.timeline(spark, last, F.col("l") + F.expr("INTERVAL 1 HOUR"), F.col("l") + F.expr("INTERVAL 25 HOURS"))
    return residual.forecast(s, ahead, lsm, model).select("port", "datetime_ist", *[F.round(c, 4).alias(c) for c in ("lsm_predicted_m", "residual_predicted_m")])


@query("carry_forward", f"WITH {_S}, span AS (SELECT port, unnest(generate_series(min(datetime_ist), max(datetime_ist), INTERVAL '1 hour')) AS datetime_ist FROM s GROUP BY port) SELECT port, datetime_ist, last_value(height_m IGNORE NULLS) OVER (PARTITION BY port ORDER BY datetime_ist) AS height_m FROM span LEFT JOIN s USING (port, datetime_ist)")
def carry_forward(spark, sf_dir):
    return _filled(spark, sf_dir)


@query("event_calibration")
def event_calibration(spark, sf_dir):
    from ..operators import calibration

    s = hourly(spark, sf_dir)
    curve = series.neighbours(s, {"f": ("height_m", 1), "p": ("height_m", -1)}).withColumn("height_m", (F.coalesce("p", "height_m") + F.col("height_m") + F.coalesce("f", "height_m")) / 3).select("port", "datetime_ist", "height_m")
    rows = calibration.training_rows(s, curve)
    models = calibration.fit(rows)
    return calibration.apply(peaks.prominent_events(curve), models)


_HOURS = "h AS (SELECT unnest(generate_series(TIMESTAMP '2024-06-01', TIMESTAMP '2024-06-02 23:00:00', INTERVAL '1 hour')) AS datetime_ist)"


@query("hourly_water_levels", f"WITH {_HOURS} SELECT 'model' AS port, datetime_ist, round({_PRED}, 6) AS predicted_height_m FROM h")
def hourly_water_levels(spark, sf_dir):
    from . import workflows

    return workflows.forecast(spark, small_model(spark), "2024-06-01 00:00:00", 48).withColumn("predicted_height_m", F.round("predicted_height_m", 6))


@query("event_forecast", f"""WITH RECURSIVE mi AS (SELECT 'model' AS port, unnest(generate_series(TIMESTAMP '2024-05-31 12:00:00', TIMESTAMP '2024-06-03 12:00:00', INTERVAL '1 minute')) AS datetime_ist),
mc AS MATERIALIZED (SELECT port, datetime_ist, {_PRED} AS height_m FROM mi), {oracles.peaks('mc', 1, 240, peaks.PROMINENCE_M)}
SELECT port, state, date_trunc('millisecond', datetime_ist) AS datetime_ist, date_trunc('millisecond', datetime_ist) - INTERVAL '5 hours 30 minutes' AS datetime_utc, round(height_m, 6) AS height_m FROM found WHERE datetime_ist >= TIMESTAMP '2024-06-01' AND datetime_ist < TIMESTAMP '2024-06-03'""")
def event_forecast(spark, sf_dir):
    from . import workflows

    events = workflows.events_forecast(spark, small_model(spark), "2024-06-01 00:00:00", 48)["events"]
    return workflows.with_utc(_to_millis(events.drop("datetime_utc")))


@query("tide_report_errors", f"""WITH RECURSIVE {_SIDES}, ow AS (SELECT * FROM o0 WHERE datetime_ist >= TIMESTAMP '2024-01-10' AND datetime_ist < TIMESTAMP '2024-01-13'), {oracles.matched('ow', 'p0', None)}
SELECT 'click' AS port, count(*) AS matched_events, round(avg(abs(time_error_minutes)), 6) AS time_mae_minutes, round(sqrt(avg(time_error_minutes * time_error_minutes)), 6) AS time_rmse_minutes, round(avg(abs(height_error_m)), 6) AS height_mae_m,
  round(sqrt(avg(height_error_m * height_error_m)), 6) AS height_rmse_m, round(avg(height_error_m), 6) AS height_bias_m FROM pairs""")
def tide_report_errors(spark, sf_dir):
    from . import workflows

    h = hourly(spark, sf_dir)
    observed = turning.turning_points(h.where("port = 'purchase'")).withColumn("port", F.lit("click"))
    return _rounded(workflows.tide_report(h.where("port = 'click'"), "2024-01-10 00:00:00", 72, observed)["errors"])


_CONST = ", ".join(f"('{n}', {p!r}::DOUBLE, {w!r}::DOUBLE, '{k}')" for n, p, w, k in harmonic.CONSTITUENTS)


@query("constituents", f"SELECT * FROM (VALUES {_CONST}) AS c(name, period_hours, speed_deg_per_hour, kind)")
def constituents(spark, sf_dir):
    return harmonic.constituents(spark)


@query("recent_history", f"WITH {_S}, o AS (SELECT o_orderpriority AS port, o_orderdate::TIMESTAMP AS datetime_ist, o_totalprice AS height_m FROM orders), l AS (SELECT port, make_timestamp(year(max(datetime_ist)) - 3, 1, 1, 0, 0, 0.0) AS f FROM o GROUP BY port) SELECT port, count(*) AS n, min(datetime_ist) AS first_ts FROM o JOIN l USING (port) WHERE datetime_ist >= f GROUP BY port")
def recent_history(spark, sf_dir):
    from ..operators import calibration

    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("port"), F.col("o_orderdate").alias("datetime_ist"), F.col("o_totalprice").alias("height_m"))
    return calibration.recent(o, "datetime_ist").groupBy("port").agg(F.count("*").alias("n"), F.min("datetime_ist").alias("first_ts"))


@query("time_value_validation", "SELECT o_orderkey, lpad((o_orderkey * 7 % 3000)::VARCHAR, 4, '0') AS value, regexp_full_match(lpad((o_orderkey * 7 % 3000)::VARCHAR, 4, '0'), '([01][0-9]|2[0-3])[0-5][0-9]') AS valid FROM orders")
def time_value_validation(spark, sf_dir):
    value = F.lpad((F.col("o_orderkey") * 7 % 3000).cast("string"), 4, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), extraction.valid_time(value).alias("valid"))


@query("anchored_rows", """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, x0, text) AS k FROM (SELECT l_orderkey % 500 AS page, l_quantity AS x0, l_extendedprice / 1000.0 AS top, l_returnflag AS text FROM lineitem)),
r AS (SELECT page, k, top AS anchor, 1 AS row FROM c WHERE k = 1 UNION ALL SELECT c.page, c.k, CASE WHEN abs(c.top - r.anchor) > 1.0 THEN c.top ELSE r.anchor END, r.row + CASE WHEN abs(c.top - r.anchor) > 1.0 THEN 1 ELSE 0 END FROM r JOIN c ON c.page = r.page AND c.k = r.k + 1)
SELECT page, round(avg(top) + 1.234567e-7, 6) AS top, string_agg(text, '' ORDER BY x0, k) AS value FROM r JOIN c USING (page, k) GROUP BY page, row""")
def anchored_rows(spark, sf_dir):
    chars = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_extendedprice") / 1000.0).alias("top"), F.col("l_returnflag").alias("text"))
    return extraction.anchored_rows(chars, ["page"], 1.0).withColumn("top", F.round(F.col("top") + 1.234567e-7, 6))  # off the ties of a mean of few 5-place numbers


@query("calibrated_identity", f"WITH {_TP} SELECT port, state, datetime_ist AS raw_datetime_ist, datetime_ist - to_milliseconds(90000) AS datetime_ist, height_m AS raw_height_m, round(height_m - 0.25, 6) AS height_m FROM t")
def calibrated_identity(spark, sf_dir):
    """Events corrected by forests that learnt one constant error each: 1.5 minutes late, 0.25 m too high."""
    from ..operators import calibration

    t = turning.turning_points(hourly(spark, sf_dir)).select("port", "state", "datetime_ist", "height_m")
    known = turning.event_features(t).withColumns({"time": F.lit(1.5), "height_error": F.lit(0.25), "observed_datetime_ist": F.col("datetime_ist")})
    out = calibration.apply(t, calibration.fit(known, trees=2, depth=2))
    return out.select("port", "state", "raw_datetime_ist", "datetime_ist", "raw_height_m", F.round("height_m", 6).alias("height_m"))
