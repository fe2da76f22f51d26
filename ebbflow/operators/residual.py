"""Residual models on top of a harmonic fit: scaler, regressors, hindcast, autoregressive forecast.

A model is a table (RESIDUAL_SCHEMA): a row per port with the scale of its residuals and weights of 168 lags, six
calendar features and a constant. It can be saved and read like any table. Weights are ridge regression, solved
per port in a grouped kernel from the summed cells of a distributed Gram matrix. A recurrent network of two
layers and a small head can score imported weights (NumPy forward pass); training one needs an external
library and is not part of this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .harmonic import fit as fit_harmonic
from .harmonic import predict
from .series import split_flags
from .turning import time_features

WINDOW = 168
TIME_COLUMNS = ("hour_sin", "hour_cos", "doy_sin", "doy_cos", "month_sin", "month_cos")


RESIDUAL_SCHEMA = "port string, mean double, std double, weights array<double>"


def residual_stats(df: DataFrame, residual: str = "residual") -> DataFrame:
    r = F.col(residual)
    return df.groupBy("port").agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.max(F.abs(r)).alias("max_abs"))


def scaler(df: DataFrame, residual: str = "residual", fraction: float = 0.8) -> DataFrame:
    """(port, mean, std + 1e-8) over the first ``fraction`` of rows."""
    train = split_flags(df, (fraction,)).where("segment = 0")
    return train.groupBy("port").agg(F.avg(residual).alias("mean"), (F.stddev_pop(residual) + 1e-8).alias("std"))


def with_residuals(series: DataFrame, model: DataFrame) -> DataFrame:
    """``series`` with lsm_predicted_m and residual (observed minus predicted)."""
    return predict(series, model, "lsm_predicted_m").withColumn("residual", F.col("height_m") - F.col("lsm_predicted_m"))


def lagged(df: DataFrame, scale: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows after the first ``window`` of a port, with ``lags`` (standardised, oldest first) and time features."""
    s = scale.select(F.col("port").alias("__p"), F.col("mean").alias("__m"), F.col("std").alias("__s"))
    z = time_features(df).join(F.broadcast(s), F.col("port") == F.col("__p")).withColumn("z", (F.col("residual") - F.col("__m")) / F.col("__s"))  # a row per port
    w = Window.partitionBy("port").orderBy("datetime_ist")
    return z.select("*", F.row_number().over(w).alias("rn"), F.collect_list("z").over(w.rowsBetween(-window, -1)).alias("lags")).where(F.col("rn") > window).drop("__p", "__m", "__s")


def _inputs(batch: pa.RecordBatch) -> np.ndarray:
    lags = np.array(batch.column("lags").to_pylist(), float)
    times = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in TIME_COLUMNS], 1)
    return np.concatenate([lags, times, np.ones((len(lags), 1))], 1)


def fit_residual(windows: DataFrame, scale: DataFrame, window: int = WINDOW, ridge: float = 1e-3) -> DataFrame:
    """Ridge regression per port (RESIDUAL_SCHEMA) from partial Gram matrices; a port's system is solved on an executor."""
    size = window + len(TIME_COLUMNS) + 2

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            full = np.concatenate([_inputs(batch), batch.column("z").to_numpy(zero_copy_only=False)[:, None]], 1)
            ports = np.array(batch.column("port").to_pylist(), object)
            for p in set(ports.tolist()):
                part = full[ports == p]
                total[p] = total.get(p, 0) + part.T @ part
        for p, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p] * size, pa.string()), pa.array(np.arange(size), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["port", "i", "row"])

    def solve(cells: pa.Table) -> pa.Table:
        g = np.zeros((size, size))
        g[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("s").to_numpy()
        w = np.linalg.solve(g[:-1, :-1] + ridge * max(1.0, g[-2, -2]) * np.eye(size - 1), g[:-1, -1])
        return pa.table({"port": pa.array([cells.column("port")[0].as_py()], pa.string()), "weights": pa.array([w.tolist()], pa.list_(pa.float64()))})

    slim = windows.select(F.col("port").cast("string").alias("port"), "z", "lags", *TIME_COLUMNS).where("z IS NOT NULL")
    parts = slim.mapInArrow(grams, "port string, i int, row array<double>")
    cells = parts.select("port", "i", F.posexplode("row").alias("j", "s")).groupBy("port", "i", "j").agg(F.sum("s").alias("s"))
    weights = cells.groupBy("port").applyInArrow(solve, "port string, weights array<double>")
    return weights.join(scale.select(F.col("port").cast("string").alias("s_port"), "mean", "std"), F.col("port") == F.col("s_port")).select("port", "mean", "std", "weights")


def hindcast(windows: DataFrame, model: DataFrame) -> DataFrame:
    """One-step-ahead residuals from true history: adds residual_predicted_m and combined_predicted_m (null without a model)."""
    m = model.select(F.col("port").alias("m_port"), "mean", "std", "weights")
    inputs = F.concat("lags", F.array(*[F.col(c).cast("double") for c in TIME_COLUMNS], F.lit(1.0)))
    z = F.aggregate(F.zip_with(inputs, "weights", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = windows.join(m, F.col("port") == F.col("m_port"), "left").withColumn("residual_predicted_m", z * F.col("std") + F.col("mean"))
    return scored.select("port", "datetime_ist", "height_m", "lsm_predicted_m", "residual_predicted_m").withColumn("combined_predicted_m", F.col("lsm_predicted_m") + F.col("residual_predicted_m"))


def context(history: DataFrame, future: DataFrame, harmonic: DataFrame, window: int) -> DataFrame:
    """The rows of ``history`` in the ``window`` hours up to min(start, last observation + 1 h), per port, with their residuals."""
    starts = future.groupBy(F.col("port").alias("c_port")).agg(F.min("datetime_ist").alias("start"))
    before = history.join(starts, F.col("port") == F.col("c_port")).where(F.col("datetime_ist") < F.col("start")).drop("c_port")
    hour = F.expr("INTERVAL 1 HOUR")
    ends = before.groupBy(F.col("port").alias("e_port")).agg(F.least(F.max("start"), F.max("datetime_ist") + hour).alias("end"))
    held = before.join(ends, F.col("port") == F.col("e_port")).where(F.col("datetime_ist") >= F.col("end") - F.expr(f"INTERVAL {window} HOURS"))
    return with_residuals(held.select("port", "datetime_ist", "height_m"), harmonic)


def forecast(history: DataFrame, future: DataFrame, harmonic: DataFrame, model: DataFrame, allow_stale_context: bool = False, window: int = WINDOW) -> DataFrame:
    """Autoregressive forecast at ``future`` (port, datetime_ist): each step feeds its residual to the next.

    Context: the last ``window`` hours up to min(start, last observation + 1 h). A context with a missing hour, or one
    that ends before the start (unless allow_stale_context), is an error. Sequential inside a port, parallel over
    ports; a port without a model has no rows.
    """
    zeros = [F.lit(0.0).cast("float").alias(c) for c in TIME_COLUMNS]
    past = context(history, future, harmonic, window).select("port", "datetime_ist", F.col("residual").alias("value"), F.lit(0).alias("kind"), *zeros)
    ahead = time_features(predict(future.select("port", "datetime_ist"), harmonic, "value")).select("port", "datetime_ist", "value", F.lit(1).alias("kind"), *TIME_COLUMNS)
    empty = {c: [] for c in ("port", "datetime_ist", "lsm_predicted_m", "residual_predicted_m")}

    def run(df: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if not len(df) or not len(fitted):
            return pd.DataFrame(empty)
        p, (mean, std, weights) = df["port"].iloc[0], fitted.iloc[0][["mean", "std", "weights"]]
        old, new = df[df["kind"] == 0].sort_values("datetime_ist"), df[df["kind"] == 1].sort_values("datetime_ist")
        if not len(new):
            return pd.DataFrame(empty)
        if len(old) != window or old["value"].isna().any():
            raise ValueError(f"the context of {p} has {len(old)} of {window} hours")
        if new["datetime_ist"].iloc[0] - old["datetime_ist"].iloc[-1] > pd.Timedelta(hours=1) and not allow_stale_context:
            raise ValueError(f"the context of {p} ends before the forecast starts")
        z = list((old["value"].to_numpy() - mean) / std)
        out = []
        for t in new[list(TIME_COLUMNS)].to_numpy(float):
            step = float(np.concatenate([z[-window:], t, [1.0]]) @ np.asarray(weights))
            z.append(step)
            out.append(step * std + mean)
        return pd.DataFrame({"port": p, "datetime_ist": new["datetime_ist"].to_numpy(), "lsm_predicted_m": new["value"].to_numpy(), "residual_predicted_m": out})

    schema = "port string, datetime_ist timestamp_ntz, lsm_predicted_m double, residual_predicted_m double"
    made = past.unionByName(ahead).groupBy("port").cogroup(model.groupBy("port")).applyInPandas(run, schema)
    return made.withColumn("combined_predicted_m", F.col("lsm_predicted_m") + F.col("residual_predicted_m"))


def train(series: DataFrame, fractions: tuple[float, float] = (0.8, 0.9), window: int = WINDOW, names: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(harmonic model, residual model, test windows): both fitted on the training segment only."""
    flagged = split_flags(series, fractions)
    harmonic = fit_harmonic(flagged.where("segment = 0").select("port", "datetime_ist", "height_m"), names)
    full = with_residuals(flagged, harmonic)
    scale = full.where("segment = 0").groupBy("port").agg(F.avg("residual").alias("mean"), (F.stddev_pop("residual") + 1e-8).alias("std"))
    windows = lagged(full.drop("rn", "n"), scale, window)
    return harmonic, fit_residual(windows.where("segment = 0"), scale, window), windows.where("segment = 2")


def lstm_forward(x: np.ndarray, weights: dict[str, np.ndarray], layers: int = 2) -> np.ndarray:
    """Next-step output of an LSTM stack and a two-layer head for (n, steps, features) inputs.

    weights: per layer l ``w_ih{l}`` (4H, in), ``w_hh{l}`` (4H, H), ``b{l}`` (4H), gates in the order input,
    forget, cell, output; head ``w1, head_b1, w2, b2``.
    """
    sigmoid = lambda v: 1.0 / (1.0 + np.exp(-v))
    seq = x
    for k in range(layers):
        w_ih, w_hh, b = weights[f"w_ih{k}"], weights[f"w_hh{k}"], weights[f"b{k}"]
        size = w_hh.shape[1]
        h, c = np.zeros((len(x), size)), np.zeros((len(x), size))
        out = np.empty((len(x), seq.shape[1], size))
        for t in range(seq.shape[1]):
            i, f, g, o = np.split(seq[:, t] @ w_ih.T + h @ w_hh.T + b, 4, axis=1)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            out[:, t] = h
        seq = out
    hidden = np.maximum(0.0, seq[:, -1] @ weights["w1"].T + weights["head_b1"])
    return (hidden @ weights["w2"].T + weights["b2"])[:, 0]
