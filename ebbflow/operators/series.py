"""Keyed series: resampling, deduplication, gaps, splits, windows and timelines.

A series is (port, datetime_ist, height_m). All ports are one table; windows are per port, and where one
port may hold most rows, ``neighbours`` splits it into calendar buckets whose borders are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import divide, hours_since, round_scaled


def hourly_series(df: DataFrame, key: str, ts: str, value: str, places: int = 6, part: str | None = None) -> DataFrame:
    """Mean value per key and hour.

    part: a column that numbers pieces of the input which no task boundary cuts (row groups). Each piece is then
    summed by itself in row order and the sums are added by number, so that splits, cores and the order of
    shuffled blocks don't decide the last bit of a mean, which decides where it lies halfway between two decimals.
    """
    keys = [F.col(key).alias("port"), F.date_trunc("HOUR", F.col(ts)).cast("timestamp_ntz").alias("datetime_ist")]
    if part is None:
        return df.groupBy(*keys).agg(round_scaled(F.avg(value), places).alias("height_m"))
    pieces = df.groupBy(*keys, part).agg(F.sum(F.col(value).cast("double")).alias("__sum"), F.count(value).alias("__n"))
    total = F.aggregate(F.sort_array(F.collect_list(F.struct(part, "__sum"))), F.lit(0.0), lambda a, x: a + F.coalesce(x["__sum"], F.lit(0.0)))
    whole = pieces.groupBy("port", "datetime_ist").agg(total.alias("__total"), F.sum("__n").alias("__n"))
    return whole.select("port", "datetime_ist", round_scaled(divide(F.col("__total"), F.col("__n")), places).alias("height_m"))


def keep_first(df: DataFrame, keys: list[Column], value: Column, order: Column) -> DataFrame:
    """One value per key: that of the least ``order``. Two-phase aggregate, no sort of the input."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("height_m"))


def keep_last(df: DataFrame, keys: list[Column], value: Column, order: Column) -> DataFrame:
    """One value per key: that of the greatest ``order`` (last write wins)."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias("height_m"))


def with_t_hours(series: DataFrame) -> DataFrame:
    return series.withColumn("t_hours", hours_since(F.col("datetime_ist")))


def neighbours(series: DataFrame, columns: dict[str, tuple[str, int]], keys: list[str] = ["port"], ts: str = "datetime_ist", bucket: str | None = None) -> DataFrame:  # noqa: B006
    """Adds lag (-1) and lead (+1) columns: {new name: (source column, -1 or 1)}.

    bucket: a date_trunc unit. Windows then span one (key, bucket), so a single long series uses many
    tasks; rows at bucket borders take the edge rows of the nearest filled bucket, a small table.
    """
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(ts)
        return series.select("*", *[(F.lag(c) if d < 0 else F.lead(c)).over(w).alias(n) for n, (c, d) in columns.items()])
    split = series.withColumn("__bucket", F.date_trunc(bucket, F.col(ts)))
    w = Window.partitionBy(*keys, "__bucket").orderBy(ts)
    marked = split.select("*", F.lag(F.lit(1)).over(w).isNull().alias("__first"), F.lead(F.lit(1)).over(w).isNull().alias("__last"), *[(F.lag(c) if d < 0 else F.lead(c)).over(w).alias(n) for n, (c, d) in columns.items()])
    names = sorted({c for c, _ in columns.values()})
    edge = F.struct(*names)
    ends = split.groupBy(*keys, "__bucket").agg(F.min_by(edge, ts).alias("lo"), F.max_by(edge, ts).alias("hi"))
    over = Window.partitionBy(*keys).orderBy("__bucket")
    borders = ends.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__k_bucket"), F.lag("hi").over(over).alias("__before"), F.lead("lo").over(over).alias("__after"))
    on = F.col("__bucket") == F.col("__k_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = marked.join(borders, on, "left")
    filled = {n: F.when(F.col("__first"), F.col(f"__before.{c}")).otherwise(F.col(n)) if d < 0 else F.when(F.col("__last"), F.col(f"__after.{c}")).otherwise(F.col(n)) for n, (c, d) in columns.items()}
    return joined.select(*series.columns, *[x.alias(n) for n, x in filled.items()])


def gap_blocks(series: DataFrame, step_minutes: int = 60) -> DataFrame:
    """Adds ``block_id`` (from 0 per port): a new block wherever the step isn't ``step_minutes``."""
    w = Window.partitionBy("port").orderBy("datetime_ist")
    gap = F.timestamp_diff("MINUTE", F.lag("datetime_ist").over(w), F.col("datetime_ist")) != step_minutes
    return series.withColumn("__gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("block_id", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__gap")


def block_summary(series: DataFrame, step_minutes: int = 60, least: int = 5) -> DataFrame:
    return gap_blocks(series, step_minutes).groupBy("port", "block_id").agg(F.count("*").alias("n_rows"), F.min("datetime_ist").alias("first_ts"), F.max("datetime_ist").alias("last_ts")).withColumn("usable", F.col("n_rows") >= least)


def split_flags(series: DataFrame, fractions: tuple[float, ...] = (0.9,)) -> DataFrame:
    """Adds ``rn`` (from 1), ``n`` and ``segment``: the number of cuts ``int(n * fraction)`` before the row."""
    w = Window.partitionBy("port")
    rows = series.select("*", F.row_number().over(w.orderBy("datetime_ist")).alias("rn"), F.count("*").over(w).alias("n"))
    segment = F.lit(0)
    for f in fractions:
        segment = segment + (F.col("rn") > F.floor(F.col("n") * F.lit(float(f)))).cast("int")
    return rows.withColumn("segment", segment)


def split_summary(series: DataFrame, fraction: float = 0.9) -> DataFrame:
    rows = split_flags(series, (fraction,))
    train = F.col("segment") == 0
    return rows.groupBy("port").agg(
        F.sum(train.cast("long")).alias("n_train"), F.sum((~train).cast("long")).alias("n_valid"),
        F.max(F.when(train, F.col("datetime_ist"))).alias("train_last"), F.min(F.when(~train, F.col("datetime_ist"))).alias("valid_first"),
    )


def sliding_windows(series: DataFrame, width: int = 168, contiguous_only: bool = False, value: str = "height_m") -> DataFrame:
    """Rows with ``window``: the ``width`` values before each row (the target), by position.

    contiguous_only leaves out windows that span a gap.
    """
    w = Window.partitionBy("port").orderBy("datetime_ist")
    rows = series.select("*", F.row_number().over(w).alias("rn"), F.collect_list(value).over(w.rowsBetween(-width, -1)).alias("window"), F.lag("datetime_ist", width).over(w).alias("__from"))
    kept = rows.where(F.col("rn") > width)
    if contiguous_only:
        kept = kept.where(F.timestamp_diff("HOUR", F.col("__from"), F.col("datetime_ist")) == width)
    return kept.drop("__from")


def timeline(spark: SparkSession, ports: DataFrame, start: Column, end: Column, step: str = "INTERVAL 1 HOUR", inclusive: bool = False) -> DataFrame:
    """(port, datetime_ist) from start to end per port; exact integer steps, half-open unless inclusive."""
    ts = F.explode(F.sequence(start, end if inclusive else end - F.expr(step), F.expr(step)))
    return ports.select("port", ts.alias("datetime_ist"))


def carry_forward(series: DataFrame, value: str = "height_m") -> DataFrame:
    """Every hour from a port's first to its last; a missing hour takes the value before it."""
    ends = series.groupBy("port").agg(F.min("datetime_ist").alias("a"), F.max("datetime_ist").alias("b"))
    hours = timeline(series.sparkSession, ends, F.col("a"), F.col("b"), inclusive=True)
    w = Window.partitionBy("port").orderBy("datetime_ist").rowsBetween(Window.unboundedPreceding, 0)
    return hours.join(series.select("port", "datetime_ist", value), ["port", "datetime_ist"], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def time_range(series: DataFrame, start: str, end: str) -> DataFrame:
    """start <= ts < end."""
    ts = F.col("datetime_ist")
    return series.where((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz")))
