"""Tables from positioned page text: rows from words or characters, complete days, events with checks.

Inputs are (page, text, x0, top[, size]) tables; decoding a page format is a source's work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import header_fields

#: X ranges of the two printed columns of an event table.
COLUMN_GEOMETRY = ((0, 234.0, 247.0, 252.0, 270.0, 271.0, 287.0), (1, 294.0, 309.0, 313.0, 331.0, 332.0, 348.0))
NUMBER = r"^-?\d+\.\d+$"


def geometry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([list(g) for g in COLUMN_GEOMETRY], "col int, day_lo double, day_hi double, time_lo double, time_hi double, height_lo double, height_hi double")


def grid_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Adds ``row_y``: top on a fixed grid (half to even)."""
    return words.withColumn("row_y", F.bround(F.col("top") / tolerance, 0) * tolerance)


def anchored_rows(chars: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, top, value): characters joined to rows; a row opens when top leaves the first one's by more
    than the tolerance. Groups are single pages' columns, so a group is small."""
    schema = ", ".join(f"{k} {dict(chars.dtypes)[k]}" for k in keys) + ", top double, value string"

    def kernel(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["top", "x0", "text"])
        rows: list[list[tuple]] = []
        for top, x0, text in zip(df["top"], df["x0"], df["text"], strict=True):
            if not rows or abs(top - rows[-1][0][0]) > tolerance:
                rows.append([])
            rows[-1].append((top, x0, text))
        head = {k: df[k].iloc[0] for k in keys}
        return pd.DataFrame([head | {"top": sum(r[0] for r in row) / len(row), "value": "".join(r[2] for r in sorted(row, key=lambda r: r[1]))} for row in rows])

    return chars.groupBy(*keys).applyInPandas(kernel, schema)


def hourly_days(words: DataFrame, headers: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(port, datetime_ist, height_m, page) of complete days: rows that open with a day of the month and hold
    exactly 24 decimals; of a day printed twice on a page the first row counts.

    headers: (page, text) with the page's text.
    """
    about = headers.select("page", header_fields(F.col("text")).alias("h")).where("h.port IS NOT NULL AND h.month IS NOT NULL")
    rows = grid_rows(words, tolerance)
    line = rows.groupBy("page", "row_y").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"))
    first = F.col("w")[0]["text"]
    decimals = F.transform(F.filter(F.slice("w", 2, F.size("w")), lambda x: x["text"].rlike(NUMBER)), lambda x: x["text"].cast("double"))
    days = line.where(first.rlike(r"^\d{1,2}$")).select("page", "row_y", first.cast("int").alias("day"), decimals.alias("v")).join(about, "page")
    days = days.where(F.col("day").between(1, F.day(F.last_day(F.make_date("h.year", "h.month", F.lit(1))))))
    days = days.withColumn("k", F.row_number().over(Window.partitionBy("page", "day").orderBy("row_y"))).where((F.col("k") == 1) & (F.size("v") == 24))
    hours = days.select("page", F.col("h.port").alias("port"), "h.year", "h.month", "day", F.posexplode("v").alias("hour", "height_m"))
    return hours.select("port", F.make_timestamp_ntz("year", "month", "day", "hour", F.lit(0), F.lit(0)).alias("datetime_ist"), "height_m", "page")


def valid_time(value: Column) -> Column:
    return value.rlike(r"^([01]\d|2[0-3])[0-5]\d$")


def table_events(chars: DataFrame, top_from: float = 140.0) -> DataFrame:
    """(page, col, day, time_value, height_m) of a printed event table; height_m is null where none is near."""
    geo = F.broadcast(geometry(chars.sparkSession))  # two rows
    digit = F.col("text").rlike(r"^\d$")
    base = chars.where(F.col("top") >= top_from).crossJoin(geo)
    inside = lambda kind: (F.col("x0") >= F.col(f"{kind}_lo")) & (F.col("x0") < F.col(f"{kind}_hi"))
    keep = ["page", "col", "text", "x0", "top"]
    labels = anchored_rows(base.where(inside("day") & (F.col("size") >= 9.0) & digit).select(*keep), ["page", "col"], 1.5)
    w = Window.partitionBy("page", "col").orderBy("top")
    days = labels.select("page", "col", F.col("value").cast("int").alias("day"), F.col("top").alias("day_top"), F.coalesce(F.lead("top").over(w), F.lit(float("inf"))).alias("next_top"))
    marks = lambda kind: anchored_rows(base.where(inside(kind) & (digit | (F.col("text") == "."))).select(*keep), ["page", "col"], 1.0)
    times = marks("time").where(valid_time(F.col("value"))).select("page", "col", F.col("top").alias("time_top"), F.col("value").alias("time_value"))
    number = F.col("value").rlike(r"^\d+(\.\d+)?$")
    heights = marks("height").select("page", "col", F.col("top").alias("h_top"), F.when(number, F.col("value")).cast("double").alias("h")).where(F.col("h").between(0.0, 15.0))
    placed = times.join(days, ["page", "col"]).where((F.col("time_top") >= F.col("day_top") - 2.0) & (F.col("time_top") < F.col("next_top") - 2.0))
    near = placed.join(heights, ["page", "col"], "left").groupBy("page", "col", "day", "time_top", "time_value").agg(F.min(F.when(F.abs(F.col("h_top") - F.col("time_top")) <= 1.0, F.struct(F.abs(F.col("h_top") - F.col("time_top")).alias("d"), F.col("h").alias("h")))).alias("best"))
    return near.select("page", "col", "day", "time_value", F.col("best.h").alias("height_m"))


def day_count_faults(events: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """Days of a port's month without 3 to 5 events, and months that lack days."""
    day = F.to_date("datetime_ist")
    per_day = events.groupBy("port", day.alias("day")).agg(F.count("*").alias("n"))
    odd = per_day.where(~F.col("n").between(least, most)).select("port", F.col("day").alias("at"), F.lit("events per day").alias("fault"))
    months = per_day.groupBy("port", F.trunc("day", "month").alias("month")).agg(F.count("*").alias("days")).where(F.col("days") != F.day(F.last_day("month")))
    return odd.unionByName(months.select("port", F.col("month").alias("at"), F.lit("days in month").alias("fault")))


def duplicate_times(events: DataFrame) -> DataFrame:
    return events.groupBy("port", "datetime_ist").agg(F.count("*").alias("n")).where("n > 1")
