"""End-to-end plans behind the command line: fit and score, forecast, validate, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_utc
from ..operators import calibration, extraction, harmonic, metrics, peaks, residual, series, turning
from ..sources import io


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def fit_and_score(obs: DataFrame, fraction: float = 0.9, datum_hours: int = harmonic.DATUM_HOURS) -> dict[str, DataFrame]:
    """model, train and validation skill, validation residuals, 19-year datums, sample forecast, summary."""
    flagged = series.split_flags(obs, (fraction,))
    model = harmonic.fit(flagged.where("segment = 0").select("port", "datetime_ist", "height_m"))
    scored = harmonic.predict(flagged, model)
    skill = metrics.skill_metrics(scored, "height_m", "predicted_m", ["port", "segment"])
    last = obs.groupBy("port").agg(F.max("datetime_ist").alias("l"))
    ahead = series.timeline(obs.sparkSession, last, F.col("l") + F.expr("INTERVAL 1 HOUR"), F.col("l") + F.expr(f"INTERVAL {datum_hours + 1} HOURS"))
    projected = harmonic.predict(ahead, model, "height_m")
    datums = harmonic.datums(projected)
    ranges = flagged.groupBy("port", "segment").agg(F.min("datetime_ist").alias("first_ts"), F.max("datetime_ist").alias("last_ts"))
    each = skill.join(ranges, ["port", "segment"]).groupBy("port").agg(*[F.max(F.when(F.col("segment") == k, F.struct("n", "bias_m", "rmse_m", "r", "sr", "first_ts", "last_ts"))).alias(n) for k, n in ((0, "train"), (1, "valid"))])
    level = model.groupBy("port").agg(F.first("mean_level_m").alias("mean_level_m"))
    summary = each.join(datums.select("port", F.struct("HAT", "MHWS", "MHW", "MSL", "MLW", "MLWS", "LAT", "RA").alias("datums_19yr")), "port").join(level, "port")
    validation = scored.where("segment = 1").select("port", "datetime_ist", "height_m", "predicted_m", (F.col("predicted_m") - F.col("height_m")).alias("residual_m"))
    until = last.select(F.col("port").alias("__p"), (F.col("l") + F.expr("INTERVAL 720 HOURS")).alias("__until"))
    sample = projected.join(F.broadcast(until), F.col("port") == F.col("__p")).where(F.col("datetime_ist") <= F.col("__until")).select("port", "datetime_ist", F.col("height_m").alias("predicted_height_m"))
    return {"model": model, "skill": skill, "validation": validation, "datums": datums, "sample": sample, "summary": summary}


def forecast(spark: SparkSession, model: DataFrame, start: str, hours: int, step_minutes: int = 60) -> DataFrame:
    """Harmonic forecast of every port of the model; ``hours`` must be positive."""
    if hours <= 0:
        raise ValueError("a forecast needs a positive length")
    ports = model.select("port").distinct()
    ahead = series.timeline(spark, ports, _ntz(start), _ntz(start) + F.expr(f"INTERVAL {hours} HOURS"), f"INTERVAL {step_minutes} MINUTES")
    return harmonic.predict(ahead, model, "predicted_height_m")


def events_forecast(spark: SparkSession, model: DataFrame, start: str, hours: int, models=None, pad_hours: int = 12) -> dict[str, DataFrame]:
    """Events between start and start + hours from a one-minute curve padded on both sides, hourly levels, frequency."""
    ports = model.select("port").distinct()
    end = _ntz(start) + F.expr(f"INTERVAL {hours} HOURS")
    pad = F.expr(f"INTERVAL {pad_hours} HOURS")
    minutes = series.timeline(spark, ports, _ntz(start) - pad, end + pad, "INTERVAL 1 MINUTE", inclusive=True)
    found = peaks.prominent_events(harmonic.predict(minutes, model, "height_m"), step_minutes=1)
    events = calibration.apply(found, models) if models else found
    kept = events.where((F.col("datetime_ist") >= _ntz(start)) & (F.col("datetime_ist") < end))
    hourly = harmonic.predict(series.timeline(spark, ports, _ntz(start), end), model, "predicted_height_m")
    return {"events": with_utc(kept), "hourly": with_utc(hourly), "frequency": turning.event_frequency(kept.select("port", "state", "datetime_ist"), with_utc=True)}


def with_utc(df: DataFrame) -> DataFrame:
    """``datetime_utc`` right after ``datetime_ist``."""
    at = df.columns.index("datetime_ist") + 1
    return df.select(*df.columns[:at], to_utc(F.col("datetime_ist")).alias("datetime_utc"), *df.columns[at:])


# ---- the event model: nodal harmonics, then forests for the errors of its events ----


def train_events(obs: DataFrame, names: list[str] | None = None, **forests: int) -> tuple[DataFrame, calibration.Models, DataFrame]:
    """(harmonic model with trend and nodal factors, calibration forests, a report row per port).

    The forests learn from events of the fitted curve matched with events of the observations.
    """
    series_of = obs.select("port", "datetime_ist", "height_m")
    model = harmonic.fit(series_of, names, trend=True, nodal=True, rayleigh=True)
    curve = harmonic.predict(series_of.select("port", "datetime_ist"), model, "height_m")
    rows = calibration.training_rows(series_of, curve)
    models = calibration.fit(rows, **forests)
    history = series_of.groupBy("port").agg(F.count("*").alias("history_rows"), F.min("datetime_ist").alias("history_start"), F.max("datetime_ist").alias("history_end"))
    terms = model.groupBy("port").agg(F.count("*").alias("constituent_count"))
    observed = peaks.prominent_events(series_of).groupBy("port").agg(F.count("*").alias("observed_historical_events"))
    matched = rows.groupBy("port").agg(F.count("*").alias("matched_historical_events"))
    used = calibration.recent(rows, "observed_datetime_ist").groupBy("port").agg(F.count("*").alias("recent_calibration_events"))
    report = history.join(terms, "port").join(observed, "port", "left").join(matched, "port", "left").join(used, "port", "left").fillna(0)
    return model, models, report.withColumn("recent_calibration_start", F.make_timestamp_ntz(F.year("history_end") - 3, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def save_event_model(model: DataFrame, models: calibration.Models, report: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(f"{path}/harmonics")
    calibration.save(models, f"{path}/calibration")
    report.write.mode("overwrite").parquet(f"{path}/report")


def load_event_model(spark: SparkSession, path: str) -> tuple[DataFrame, calibration.Models | None]:
    """What ``save_event_model`` wrote; a folder that is a bare model table has no calibration."""
    if io.exists(spark, f"{path}/harmonics"):
        return spark.read.parquet(f"{path}/harmonics"), calibration.load(f"{path}/calibration")
    return spark.read.parquet(path), None


def validate_events(model: DataFrame, models: calibration.Models | None, references: DataFrame, pad_hours: int = 12) -> dict[str, DataFrame]:
    """Predicted events, matches and gates against reference events (port, state, datetime_ist, height_m).

    A port is predicted from midnight of its first reference day to midnight after its last one. A reference
    port without a model is an error.
    """
    spark = references.sparkSession
    day = lambda c: F.date_trunc("DAY", c).cast("timestamp_ntz")
    spans = references.groupBy("port").agg(day(F.min("datetime_ist")).alias("start"), (day(F.max("datetime_ist")) + F.expr("INTERVAL 1 DAY")).alias("end"))
    lacking = [r.port for r in spans.join(model.select("port").distinct(), "port", "left_anti").select("port").limit(10).collect()]
    if lacking:
        raise ValueError(f"no model for {', '.join(sorted(lacking))}")
    pad = F.expr(f"INTERVAL {pad_hours} HOURS")
    minutes = series.timeline(spark, spans, F.col("start") - pad, F.col("end") + pad, "INTERVAL 1 MINUTE", inclusive=True)
    found = peaks.prominent_events(harmonic.predict(minutes, model, "height_m"), step_minutes=1)
    events = calibration.apply(found, models) if models else found
    bounds = spans.select(F.col("port").alias("b_port"), "start", "end")
    kept = events.join(bounds, F.col("port") == F.col("b_port")).where((F.col("datetime_ist") >= F.col("start")) & (F.col("datetime_ist") < F.col("end"))).drop("b_port", "start", "end")
    errors = peaks.match_events(references.select("port", "state", "datetime_ist", "height_m"), kept.select("port", "state", "datetime_ist", "height_m"))
    counts = references.groupBy("port").agg(F.count("*").alias("observed_events"))
    return {"predicted": kept, "errors": errors, "metrics": metrics.event_report(metrics.event_errors(errors, counts))}


def validate_forecast(obs: DataFrame, predicted: DataFrame, column: str = "combined_predicted_m") -> dict[str, DataFrame]:
    """Overall and horizon skill of a forecast joined to observations; an empty join is an error."""
    joined = obs.join(predicted.drop("height_m"), ["port", "datetime_ist"])
    if joined.isEmpty():
        raise ValueError("forecast and observations have no hour in common")
    errors = joined.withColumn("error_m", F.col(column) - F.col("height_m"))
    return {"rows": errors, "overall": metrics.skill_metrics(joined, "height_m", column, ["port"]), "horizons": metrics.horizon_metrics(joined, "height_m", column, ["port"], "datetime_ist")}


def tide_report(curve: DataFrame, start: str, hours: int = 24, observed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Hourly rows with tide tags, events in the window, frequency, and errors against observed events.

    Events are found on the whole curve; matching is unbounded and may use events outside the window.
    """
    everything = turning.turning_points(curve)
    inside = lambda df: df.where((F.col("datetime_ist") >= _ntz(start)) & (F.col("datetime_ist") < _ntz(start) + F.expr(f"INTERVAL {hours} HOURS")))
    window, events = inside(curve), inside(everything)
    if window.isEmpty():
        raise ValueError("no forecast rows in the window")
    out = {"hourly": turning.nearest_hour_tags(window, events), "events": events, "frequency": turning.event_frequency(events)}
    if observed is not None:
        pairs = peaks.match_events(inside(observed), everything, None)
        out |= {"matches": pairs, "errors": metrics.report_errors(pairs)}
    return out


def train_residual(obs: DataFrame, window: int = residual.WINDOW, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Harmonic model, residual model, hindcast of the test segment and its skill with and without the residual model."""
    lsm, model, test = residual.train(obs, window=window, names=names)
    rows = residual.hindcast(test, model)
    both = [metrics.skill_metrics(rows, "height_m", c, ["port"]).withColumn("prediction", F.lit(c)) for c in ("lsm_predicted_m", "combined_predicted_m")]
    return {"harmonics": lsm, "residual": model, "hindcast": rows, "skill": both[0].unionByName(both[1])}


def load_residual(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/harmonics"), spark.read.parquet(f"{path}/residual")


def hybrid(obs: DataFrame, start: str, hours: int, allow_stale_context: bool = False, fitted: tuple[DataFrame, DataFrame] | None = None, window: int = residual.WINDOW) -> DataFrame:
    """Harmonic plus autoregressive residual forecast, by ``fitted`` models or by ones trained on what lies before ``start``."""
    history = obs.where(F.col("datetime_ist") < _ntz(start))
    lsm, model = fitted or residual.train(history, window=window)[:2]
    ahead = series.timeline(obs.sparkSession, obs.select("port").distinct(), _ntz(start), _ntz(start) + F.expr(f"INTERVAL {hours} HOURS"))
    return residual.forecast(history, ahead, lsm, model, allow_stale_context, window)


def hybrid_hindcast(obs: DataFrame, start: str, end: str, fitted: tuple[DataFrame, DataFrame], window: int = residual.WINDOW) -> DataFrame:
    """Observed hours from ``start`` to before ``end``, each predicted from the true residuals of the ``window`` rows before it."""
    lsm, model = fitted
    full = residual.with_residuals(obs.select("port", "datetime_ist", "height_m").where(F.col("datetime_ist") < _ntz(end)), lsm)
    rows = residual.hindcast(residual.lagged(full, model, window), model)
    inside = rows.where(F.col("datetime_ist") >= _ntz(start))
    if inside.isEmpty():
        raise ValueError("no observed hour with enough history in the range")
    return inside


# ---- tables from positioned page text ----


def extract_hourly(words: DataFrame, headers: DataFrame) -> DataFrame:
    """Hourly rows of all pages, the last page's value where two give one hour; pages without a header have none."""
    rows = extraction.hourly_days(words, headers)
    return io.last_write(rows, F.struct("page"))


def extract_events(chars: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, faults) of event tables, a page per port and month: chars (page, text, x0, top, size), headers (page, port, year, month).

    Faults (port, at, fault): times without a height, repeated times, days with other than 3 to 5 events, months that
    lack days, states that don't alternate. Events with a fault are still listed; a caller that wants none checks.
    """
    found = extraction.table_events(chars).join(headers, "page")
    at = F.make_timestamp_ntz("year", "month", "day", F.substring("time_value", 1, 2).cast("int"), F.substring("time_value", 3, 2).cast("int"), F.lit(0))
    placed = found.where(F.col("day").between(1, F.day(F.last_day(F.make_date("year", "month", F.lit(1)))))).select("port", at.alias("datetime_ist"), "height_m")
    states = turning.alternate_states(placed.where("height_m IS NOT NULL"))
    fault = lambda df, text: df.select("port", F.col("datetime_ist").cast("date").alias("at"), F.lit(text).alias("fault"))
    faults = fault(placed.where("height_m IS NULL"), "no height").unionByName(fault(extraction.duplicate_times(placed), "repeated time")).unionByName(fault(states.where("breaks"), "states don't alternate")).unionByName(extraction.day_count_faults(placed))
    return states.select("port", "datetime_ist", "state", "height_m"), faults


# ---- data behind the charts ----


def first_days(df: DataFrame, days: int) -> DataFrame:
    """The first ``days`` * 24 rows of each port."""
    from pyspark.sql import Window

    w = Window.partitionBy("port").orderBy("datetime_ist")
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 24 * days).drop("__rn")


def chart_tables(validation: DataFrame, model: DataFrame) -> dict[str, DataFrame]:
    """Comparison rows, scatter pairs, residual histogram, amplitude bars, error boxes, residuals over time and by hour."""
    by_hour = validation.groupBy("port", F.hour("datetime_ist").alias("hour")).agg(F.avg("residual_m").alias("mean_m"), F.stddev_pop("residual_m").alias("std_m"))
    daily = validation.groupBy("port", F.to_date("datetime_ist").alias("day")).agg(F.avg("residual_m").alias("mean_m"), F.sqrt(F.avg(F.pow("residual_m", F.lit(2)))).alias("rmse_m"))
    return {
        "by_hour": by_hour, "daily": daily,
        "comparison": first_days(validation, 15), "scatter": validation.select("port", "height_m", "predicted_m"), "histogram": metrics.histogram(validation, "residual_m", "port"),
        "amplitudes": model.select("port", "name", "amplitude_m").orderBy(F.desc("amplitude_m")).limit(13), "boxes": metrics.box_stats(validation, "residual_m", "port"),
    }


def save(tables: dict[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def summary_report(summaries: DataFrame) -> DataFrame:
    """A row per port: validation skill and range, the worst port first (of the tables ``fit_and_score`` calls summary)."""
    return summaries.select("port", F.col("valid.n").alias("n"), F.col("valid.rmse_m").alias("rmse_m"), F.col("valid.bias_m").alias("bias_m"), F.col("valid.r").alias("r"), "mean_level_m", F.col("datums_19yr.RA").alias("range_m")).orderBy(F.desc("rmse_m"), "port")
