"""Turning points of hourly curves, their frequency, features and tags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MOON_EPOCH, SYNODIC_MONTH_DAYS, clip, cyclic, micros_between, round_scaled, shift_micros, to_utc, vertex
from .series import neighbours

STATES = ("High", "Low")


def turning_points(series: DataFrame, bucket: str | None = None, places: int = 4) -> DataFrame:
    """port, state, datetime_ist, height_m, is_boundary_estimate.

    The first row of a port is an event by its next row alone; the last row never is one. Interior
    events are refined by a parabola, in whole milliseconds.
    """
    n = neighbours(series, {"__p": ("height_m", -1), "__f": ("height_m", 1)}, bucket=bucket)
    p, c, f = F.col("__p"), F.col("height_m"), F.col("__f")
    first = p.isNull()
    state = F.when(first & (c > f), "High").when(first & (c < f), "Low").when((c >= p) & (c > f), "High").when((c <= p) & (c < f), "Low")
    offset, height = vertex(p, c, f)
    found = n.where(f.isNotNull()).withColumn("state", state).where(F.col("state").isNotNull())
    at = F.when(first, F.col("datetime_ist")).otherwise(shift_micros(F.col("datetime_ist"), F.round(offset * 3_600_000).cast("long") * 1000))
    return found.select("port", "state", at.alias("datetime_ist"), round_scaled(F.when(first, c).otherwise(height), places).alias("height_m"), first.alias("is_boundary_estimate"))


def event_frequency(events: DataFrame, with_utc: bool = False) -> DataFrame:
    """Per port and state (both always): count, mean gap in hours (null below two), HH:mm times joined."""
    w = Window.partitionBy("port", "state").orderBy("datetime_ist")
    gaps = events.withColumn("__gap", micros_between(F.lag("datetime_ist").over(w), F.col("datetime_ist")) / 3.6e9)
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda t: F.date_format(t, "HH:mm")), ", ")
    extra = [joined(to_utc(F.col("datetime_ist"))).alias("event_times_utc")] if with_utc else []
    stats = gaps.groupBy("port", "state").agg(F.count("*").alias("count"), F.avg("__gap").alias("average_interval_hours"), joined("datetime_ist").alias("event_times_ist"), *extra)
    grid = events.select("port").distinct().withColumn("state", F.explode(F.array(*map(F.lit, STATES))))
    out = grid.join(stats, ["port", "state"], "left")
    texts = ["event_times_ist"] + (["event_times_utc"] if with_utc else [])
    return out.select("port", "state", F.coalesce("count", F.lit(0)).alias("count"), "average_interval_hours", *[F.coalesce(t, F.lit("")).alias(t) for t in texts])


def alternate_states(events: DataFrame) -> DataFrame:
    """State by comparing with the event before (the first: with the one after); adds ``breaks`` where it repeats."""
    w = Window.partitionBy("port").orderBy("datetime_ist")
    other = F.coalesce(F.lag("height_m").over(w), F.lead("height_m").over(w))
    marked = events.withColumn("state", F.when(F.col("height_m") > other, "High").otherwise("Low"))
    return marked.withColumn("breaks", F.coalesce(F.lag("state").over(w) == F.col("state"), F.lit(False)))


def nearest_hour_tags(hourly: DataFrame, events: DataFrame) -> DataFrame:
    """The hourly rows with ``tide_state``: '' or the state of the last event nearest to the hour.

    An event reaches the two hours around it only, so it needs no search: ties go to the earlier hour,
    and of events on one hour the latest wins.
    """
    hour = F.date_trunc("HOUR", F.col("datetime_ist")).cast("timestamp_ntz")
    cand = events.select("port", F.col("state"), F.col("datetime_ist").alias("event_ts"), F.explode(F.array(hour, hour + F.expr("INTERVAL 1 HOUR"))).alias("datetime_ist"))
    near = cand.join(hourly.select("port", "datetime_ist"), ["port", "datetime_ist"]).groupBy("port", "state", "event_ts").agg(F.min(F.struct(F.abs(micros_between(F.col("event_ts"), F.col("datetime_ist"))).alias("d"), "datetime_ist")).alias("best"))
    tags = near.groupBy("port", F.col("best.datetime_ist").alias("datetime_ist")).agg(F.max_by("state", F.struct("event_ts", "state")).alias("tide_state"))
    return hourly.join(tags, ["port", "datetime_ist"], "left").withColumn("tide_state", F.coalesce("tide_state", F.lit("")))


def event_features(events: DataFrame) -> DataFrame:
    """The 17 features of an event from its neighbours, the calendar and the moon."""
    w = Window.partitionBy("port").orderBy("datetime_ist")
    ts, h = F.col("datetime_ist"), F.col("height_m")
    before, after = F.coalesce(F.lag(h).over(w), h), F.coalesce(F.lead(h).over(w), h)
    gap = lambda a, b: clip(F.coalesce(micros_between(a, b) / 3.6e9, F.lit(6.0)), 0.0, 24.0)
    hour = F.hour(ts) + F.minute(ts) / 60.0
    day = F.dayofyear(ts) + F.hour(ts) / 24.0 + F.minute(ts) / 1440.0
    since = lambda t: micros_between(F.lit(t).cast("timestamp_ntz"), ts) / 1e6
    moon = since(MOON_EPOCH) / 86400.0 / SYNODIC_MONTH_DAYS * (2 * math.pi)
    cols: dict[str, Column] = {
        "state_high": (F.col("state") == "High").cast("double"), "height": h, "previous_height": before, "following_height": after, "previous_range": F.abs(h - before), "following_range": F.abs(h - after),
        "previous_interval": gap(F.lag(ts).over(w), ts), "following_interval": gap(ts, F.lead(ts).over(w)), "hour_sin": cyclic(hour, 24)[0], "hour_cos": cyclic(hour, 24)[1], "day_of_year_sin": cyclic(day, 365.25)[0], "day_of_year_cos": cyclic(day, 365.25)[1],
        "moon_sin": F.sin(moon), "moon_cos": F.cos(moon), "moon_second_harmonic_sin": F.sin(2 * moon), "moon_second_harmonic_cos": F.cos(2 * moon), "elapsed_years": since("2000-01-01 00:00:00") / (365.25 * 86400.0),
    }
    return events.select("port", "state", "datetime_ist", *[c.alias(n) for n, c in cols.items()])


FEATURE_NAMES = (
    "state_high height previous_height following_height previous_range following_range previous_interval following_interval hour_sin hour_cos day_of_year_sin day_of_year_cos"
    " moon_sin moon_cos moon_second_harmonic_sin moon_second_harmonic_cos elapsed_years"
).split()


def time_features(series: DataFrame) -> DataFrame:
    """Six cyclic features of hour, day of year and month, FLOAT."""
    ts = F.col("datetime_ist")
    out = []
    for name, x, period in (("hour", F.hour(ts), 24.0), ("doy", F.dayofyear(ts), 365.25), ("month", F.month(ts), 12.0)):
        s, c = cyclic(x, period)
        out += [s.cast("float").alias(f"{name}_sin"), c.cast("float").alias(f"{name}_cos")]
    return series.select("*", *out)
