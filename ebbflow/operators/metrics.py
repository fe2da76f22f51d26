"""Skill, horizon, event and distribution metrics: single two-phase aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import divide

HORIZONS = (6, 12, 24, 48, 72)


def skill(observed: Column, predicted: Column) -> list[Column]:
    """n (rows with both values), bias, rmse, Pearson r (null at zero variance), symmetric slope sr (null where all observed are 0)."""
    d = predicted - observed
    varied = (F.var_pop(predicted) > 0) & (F.var_pop(observed) > 0)
    return [
        F.count(d).alias("n"), F.avg(d).alias("bias_m"), F.sqrt(F.avg(d * d)).alias("rmse_m"),
        F.when(varied, divide(F.covar_pop(predicted, observed), F.stddev_pop(predicted) * F.stddev_pop(observed))).alias("r"),
        F.sqrt(divide(F.sum(predicted * predicted), F.sum(observed * observed))).alias("sr"),
    ]


def skill_metrics(df: DataFrame, observed: str, predicted: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*skill(F.col(observed), F.col(predicted)))


def horizon_metrics(df: DataFrame, observed: str, predicted: str, by: list[str], order: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Skill over the first h rows for each h with at least h rows.

    Only the first max(h) rows of a key are kept, by row number, before they meet the horizons.
    """
    w = Window.partitionBy(*by).orderBy(order)
    first = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(horizons))
    each = first.withColumn("horizon", F.explode(F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: h >= F.col("__rn"))))
    return each.groupBy(*by, "horizon").agg(*skill(F.col(observed), F.col(predicted))).where(F.col("n") >= F.col("horizon"))


def event_errors(pairs: DataFrame, observed_counts: DataFrame, minutes: float = 30.0, metres: float = 0.3, passing: float = 95.0) -> DataFrame:
    """Per port: matched and observed counts, MAE, RMSE, accuracies over *observed* events, gates.

    pairs: (port, time_error_minutes, height_error_m); observed_counts: (port, observed_events).
    """
    t, h = F.abs("time_error_minutes"), F.abs("height_error_m")
    agg = pairs.groupBy("port").agg(
        F.count("*").alias("matched_events"), F.avg(t).alias("time_mae_minutes"), F.sqrt(F.avg(t * t)).alias("time_rmse_minutes"), F.avg(h).alias("height_mae_m"), F.sqrt(F.avg(h * h)).alias("height_rmse_m"),
        F.count_if(t <= minutes).alias("__t"), F.count_if(h <= metres).alias("__h"), F.count_if((t <= minutes) & (h <= metres)).alias("__j"),
    )
    joined = observed_counts.join(agg, "port", "left")
    share = lambda c: 100.0 * F.coalesce(F.col(c), F.lit(0)) / F.col("observed_events")
    out = joined.where("observed_events > 0").select(
        "port", "observed_events", F.coalesce("matched_events", F.lit(0)).alias("matched_events"), share("matched_events").alias("match_rate_percent"), "time_mae_minutes", "time_rmse_minutes", "height_mae_m", "height_rmse_m",
        share("__t").alias("timing_accuracy_percent"), share("__h").alias("height_accuracy_percent"), share("__j").alias("joint_accuracy_percent"),
    )
    gate = lambda c: F.col(f"{c}_accuracy_percent") >= passing
    return out.select("*", gate("timing").alias("timing_pass"), gate("height").alias("height_pass"), gate("joint").alias("joint_pass"))


def event_report(errors: DataFrame, minutes: float = 30.0, metres: float = 0.3) -> DataFrame:
    """``event_errors`` under the names of the event report, with the gates it was held against."""
    return errors.select(
        "port", "observed_events", "matched_events", "match_rate_percent", "time_mae_minutes", "time_rmse_minutes", F.col("timing_accuracy_percent").alias("time_accuracy_percent"), "height_mae_m", "height_rmse_m", "height_accuracy_percent",
        "joint_accuracy_percent", F.lit(minutes).alias("time_gate_minutes"), F.lit(metres).alias("height_gate_m"), F.col("timing_pass").alias("passes_time_accuracy_gate"), F.col("height_pass").alias("passes_height_accuracy_gate"), F.col("joint_pass").alias("passes_joint_accuracy_gate"),
    )


def report_errors(pairs: DataFrame) -> DataFrame:
    t, h = F.col("time_error_minutes"), F.col("height_error_m")
    return pairs.groupBy("port").agg(F.count("*").alias("matched_events"), F.avg(F.abs(t)).alias("time_mae_minutes"), F.sqrt(F.avg(t * t)).alias("time_rmse_minutes"), F.avg(F.abs(h)).alias("height_mae_m"), F.sqrt(F.avg(h * h)).alias("height_rmse_m"), F.avg(h).alias("height_bias_m"))


def histogram(df: DataFrame, value: str, series: str, bins: int = 80) -> DataFrame:
    """Equal bins over the shared range of all series; the last bin is closed on the right."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), width).otherwise(1.0)))).otherwise(0)
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).withColumn("bin", at.cast("int")).groupBy(series, "bin").agg(F.count("*").alias("n"))  # span: one row


def box_stats(df: DataFrame, value: str, series: str) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers."""
    q = df.groupBy(F.col(series).alias("__s")).agg(*[F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return df.join(q, F.col(series) == F.col("__s")).groupBy(series, "q1", "median", "q3").agg(F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"))


def improvement_percent(before: Column, after: Column) -> Column:
    return 100.0 * divide(before - after, before)
