"""Event calibration: tree ensembles for the time and height errors of predicted events (Spark ML).

Extra-trees with random thresholds have no built-in; a random forest without bootstrap on the same
depth of data stands in for it, so corrections differ in detail.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import shift_micros
from .peaks import match_events, prominent_events
from .turning import FEATURE_NAMES, event_features


def _forest(label: str, trees: int, least_leaf: int, depth: int) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol=f"{label}_correction", numTrees=trees, minInstancesPerNode=least_leaf, featureSubsetStrategy="0.9", bootstrap=False, subsamplingRate=1.0, maxDepth=depth, seed=1)


def assembled(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features").transform(features)


def numbered(events: DataFrame) -> DataFrame:
    return events.withColumn("predicted_index", (F.row_number().over(Window.partitionBy("port").orderBy("datetime_ist", "state")) - 1).cast("long"))


def recent(df: DataFrame, ts: str, years: int = 3) -> DataFrame:
    """Rows from January 1 of (year of the last row - years), per port."""
    last = df.groupBy(F.col("port").alias("__p")).agg(F.make_timestamp_ntz(F.year(F.max(ts)) - years, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("__from"))
    return df.join(last, F.col("port") == F.col("__p")).where(F.col(ts) >= F.col("__from")).drop("__p", "__from")


def training_rows(observed: DataFrame, predicted_curve: DataFrame, step_minutes: int = 60) -> DataFrame:
    """Features of predicted events with their time (minutes) and height errors against observed ones."""
    predicted = numbered(prominent_events(predicted_curve, step_minutes))
    pairs = match_events(prominent_events(observed, step_minutes), predicted)
    features = event_features(predicted).join(predicted.select("port", "state", "datetime_ist", "predicted_index"), ["port", "state", "datetime_ist"])
    errors = pairs.select("port", "predicted_index", "observed_datetime_ist", F.col("time_error_minutes").alias("time"), F.col("height_error_m").alias("height_error"))
    return features.join(errors, ["port", "predicted_index"])


Models = tuple[RandomForestRegressionModel, RandomForestRegressionModel]


def fit(rows: DataFrame, trees: int = 160, least_leaf: int = 15, depth: int = 12) -> Models:
    """(time model on recent rows, height model on all)."""
    data = assembled(rows).persist()  # a forest reads its rows once a level
    try:
        return _forest("time", trees, least_leaf, depth).fit(recent(data, "observed_datetime_ist")), _forest("height_error", trees, least_leaf, depth).fit(data)
    finally:
        data.unpersist()


def save(models: Models, path: str) -> None:
    for model, name in zip(models, ("time", "height"), strict=True):
        model.write().overwrite().save(f"{path}/{name}")


def load(path: str) -> Models:
    return RandomForestRegressionModel.load(f"{path}/time"), RandomForestRegressionModel.load(f"{path}/height")


def apply(events: DataFrame, models: Models) -> DataFrame:
    """Events with corrected time and height beside the raw ones."""
    scored = models[1].transform(models[0].transform(assembled(event_features(events))))
    micros = F.round(F.col("time_correction") * 6e7).cast("long")
    return scored.select(
        "port", "state", shift_micros(F.col("datetime_ist"), -micros).alias("datetime_ist"), (F.col("height") - F.col("height_error_correction")).alias("height_m"), F.col("datetime_ist").alias("raw_datetime_ist"), F.col("height").alias("raw_height_m"),
        F.col("time_correction").alias("time_correction_minutes"), F.col("height_error_correction").alias("height_correction_m"),
    )
