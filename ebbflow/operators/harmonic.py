"""Harmonic models: constituents, least squares fit, prediction, datums, nodal corrections.

The fit never materialises a design matrix. Each Arrow batch adds to a partial Gram matrix per port
(41 x 41 numbers), partials are summed by a two-phase aggregate, and each port's small system is solved in a
grouped Arrow kernel on its summed cells: nothing is collected, however many ports there are. Prediction joins
the model once per port as an array of terms; for one known model it unrolls into a single expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hours_since, phase_degrees

#: Name, period in hours, speed in degrees an hour, kind. Only the speed enters the mathematics.
CONSTITUENTS = (
    ("M2", 12.4206012, 28.9841042, "semidiurnal"),
    ("S2", 12.0, 30.0, "semidiurnal"),
    ("N2", 12.65834751, 28.4397295, "semidiurnal"),
    ("K2", 11.96723606, 30.0821373, "semidiurnal"),
    ("K1", 23.93447213, 15.0410686, "diurnal"),
    ("O1", 25.81933871, 13.9430356, "diurnal"),
    ("P1", 24.06588766, 14.9589314, "diurnal"),
    ("Q1", 26.86835, 13.3986609, "diurnal"),
    ("Mf", 327.8599387, 1.0980331, "long-period"),
    ("Msf", 354.3670666, 1.0158958, "long-period"),
    ("Mm", 661.3111655, 0.5443747, "long-period"),
    ("M4", 6.2103006, 57.9682084, "shallow-water"),
    ("MS4", 6.10333927, 58.9841042, "shallow-water"),
    ("MN4", 6.2691732, 57.4238337, "shallow-water"),
    ("M6", 4.1402004, 86.9523127, "shallow-water"),
    ("S4", 6.0, 60.0, "shallow-water"),
    ("2N2", 12.90537297, 27.8953548, "semidiurnal"),
    ("Sa", 8766.15265, 0.0410686, "long-period"),
    ("Ssa", 4383.07632, 0.0821373, "long-period"),
)
SPEEDS = {name: speed for name, _, speed, _ in CONSTITUENTS}
DATUM_HOURS = (365 * 19 + 5) * 24


def constituents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([list(c) for c in CONSTITUENTS], "name string, period_hours double, speed_deg_per_hour double, kind string")


def design(t: Column, names: list[str]) -> list[Column]:
    """cos_<name>, sin_<name> columns of the design matrix (the constant column is left out)."""
    out = []
    for n in names:
        angle = F.radians(F.lit(SPEEDS[n])) * t
        out += [F.cos(angle).alias(f"cos_{n}"), F.sin(angle).alias(f"sin_{n}")]
    return out


def resolvable(names: list[str], span_hours: float) -> list[str]:
    """Rayleigh criterion: in the given order, constituents at least 360 degrees a span from all kept ones (and from 0)."""
    kept: list[str] = []
    for n in names:
        if span_hours * SPEEDS[n] >= 360.0 and all(span_hours * abs(SPEEDS[n] - SPEEDS[k]) >= 360.0 for k in kept):
            kept.append(n)
    return kept


def _grams(batches: Iterator[pa.RecordBatch], names: list[str], trend: bool, nodal: bool) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        port = np.array(batch.column("port").to_pylist(), object)
        t, y = batch.column("t_hours").to_numpy(zero_copy_only=False), batch.column("height_m").to_numpy(zero_copy_only=False)
        x = design_matrix(t, names, trend, nodal)
        full = np.concatenate([x, y[:, None]], 1)
        for p in set(port.tolist()):
            part = full[port == p]
            total[p] = total.get(p, 0) + part.T @ part
    size = 2 + 2 * len(names) + trend
    i, j = np.divmod(np.arange(size * size), size)
    for p, g in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([p] * size * size, pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g.ravel(), pa.float64())], ["port", "i", "j", "s"])


def design_matrix(t: np.ndarray, names: list[str], trend: bool = False, nodal: bool = False) -> np.ndarray:
    """[1, cos, sin, ...(, years)] for hours t since the epoch."""
    cols = [np.ones_like(t)]
    for n in names:
        f, u = nodal_factors(n, t) if nodal else (1.0, 0.0)
        angle = np.radians(SPEEDS[n]) * t + u
        cols += [f * np.cos(angle), f * np.sin(angle)]
    if trend:
        cols.append(t / 8766.0)
    return np.stack(cols, 1)


def gram(series: DataFrame, names: list[str], trend: bool = False, nodal: bool = False) -> DataFrame:
    """(port, i, j, s): sums of products of the design columns; the last index is the height."""
    slim = series.select(F.col("port").cast("string").alias("port"), hours_since(F.col("datetime_ist")).alias("t_hours"), F.col("height_m").cast("double").alias("height_m")).where("height_m IS NOT NULL AND t_hours IS NOT NULL")
    partial = slim.mapInArrow(lambda it: _grams(it, names, trend, nodal), "port string, i int, j int, s double")
    return partial.groupBy("port", "i", "j").agg(F.sum("s").alias("s"))


def gram_sql(series: DataFrame, names: list[str]) -> DataFrame:
    """The same sums by one aggregate of generated expressions, for few constituents: (port, i, j, s)."""
    t = hours_since(F.col("datetime_ist"))
    x = [F.lit(1.0), *design(t, names), F.col("height_m")]
    n = len(x)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    sums = series.groupBy("port").agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in cells])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("s")) for i, j in cells])).alias("c")
    return sums.select("port", rows).select("port", "c.i", "c.j", "c.s")


MODEL_SCHEMA = "port string, name string, kind string, period_hours double, speed_deg_per_hour double, amplitude_m double, phase_deg double, A_cos double, B_sin double, mean_level_m double, trend_m_per_year double, nodal boolean"


def _solved(cells: pa.Table, names: list[str], trend: bool, nodal: bool, rayleigh: bool) -> pa.Table:
    """The model rows of one port from its summed cells (port, i, j, s) and the hours it spans."""
    about = {c[0]: c for c in CONSTITUENTS}
    size = 2 + 2 * len(names) + trend
    g = np.zeros((size, size))
    g[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("s").to_numpy()
    used = resolvable(names, cells.column("span")[0].as_py()) if rayleigh else names
    at = [0, *(k for n in used for k in (1 + 2 * names.index(n), 2 + 2 * names.index(n))), *([size - 2] if trend else [])]
    w = np.linalg.lstsq(g[np.ix_(at, at)], g[at, -1], rcond=None)[0]
    port, rows = cells.column("port")[0].as_py(), []
    for k, n in enumerate(used):
        a, b = float(w[1 + 2 * k]), float(w[2 + 2 * k])
        rows.append((port, n, about[n][3], about[n][1], about[n][2], math.hypot(a, b), math.degrees(math.atan2(b, a)) % 360.0, a, b, float(w[0]), float(w[-1]) if trend else 0.0, nodal))
    kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in MODEL_SCHEMA.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(fields)})


def fit(series: DataFrame, names: list[str] | None = None, trend: bool = False, nodal: bool = False, rayleigh: bool = False) -> DataFrame:
    """The model table (MODEL_SCHEMA), one row per port and constituent. Minimum-norm least squares.

    rayleigh: of ``names``, each port uses those that its own span of time can tell apart. A port in whose span
    none can be told apart has no rows. An unknown name is an error.
    """
    names = list(names or SPEEDS)
    unknown = [n for n in names if n not in SPEEDS]
    if unknown:
        raise ValueError(f"unknown constituents: {', '.join(unknown)}")
    t = hours_since(F.col("datetime_ist"))
    span = series.where("height_m IS NOT NULL").groupBy(F.col("port").cast("string").alias("s_port")).agg((F.max(t) - F.min(t) + 1).cast("double").alias("span"))
    cells = gram(series, names, trend, nodal).join(span, F.col("port") == F.col("s_port")).select("port", "i", "j", "s", "span")
    return cells.groupBy("port").applyInArrow(lambda c: _solved(c, names, trend, nodal, rayleigh), MODEL_SCHEMA)


def predict(series: DataFrame, model: DataFrame, column: str = "predicted_m") -> DataFrame:
    """``series`` with the model's height. The model travels as one array per port (K small structs).

    A port fitted with nodal modulation (column ``nodal``) is predicted with it.
    """
    names = list(SPEEDS)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")) - 1
    term = F.struct(F.radians("speed_deg_per_hour").alias("w"), F.col("A_cos").alias("a"), F.col("B_sin").alias("b"), place.cast("int").alias("at"))
    per_port = model.groupBy(F.col("port").alias("m_port")).agg(F.first("mean_level_m").alias("__h0"), F.first("trend_m_per_year").alias("__trend"), F.first("nodal").alias("__nodal"), F.array_sort(F.collect_list(term)).alias("__c"))
    t = hours_since(F.col("datetime_ist"))
    start = F.col("__h0") + F.col("__trend") * t / 8766.0
    plain = F.aggregate("__c", start, lambda acc, c: acc + c["a"] * F.cos(c["w"] * t) + c["b"] * F.sin(c["w"] * t))
    factors = F.array(*[F.struct(f.alias("f"), u.alias("u")) for f, u in (nodal_columns(n, t) for n in names)])

    def moved(acc: Column, c: Column) -> Column:
        angle = c["w"] * t + F.get("__factors", c["at"])["u"]
        return acc + F.get("__factors", c["at"])["f"] * (c["a"] * F.cos(angle) + c["b"] * F.sin(angle))

    joined = series.join(per_port, F.col("port") == F.col("m_port"), "left").withColumn("__factors", F.when(F.col("__nodal"), factors))
    tide = F.when(F.col("__nodal"), F.aggregate("__c", start, moved)).otherwise(plain)
    return joined.withColumn(column, tide).drop("m_port", "__h0", "__trend", "__nodal", "__c", "__factors")


def predict_expr(t: Column, mean_level: float, terms: list[tuple[float, float, float]]) -> Column:
    """Height at hours t for one port's (speed, A, B) terms, unrolled into one expression."""
    out = F.lit(float(mean_level))
    for speed, a, b in terms:
        angle = F.radians(F.lit(speed)) * t
        out = out + F.lit(a) * F.cos(angle) + F.lit(b) * F.sin(angle)
    return out


def amp_phase(a: Column, b: Column) -> tuple[Column, Column]:
    return F.sqrt(a * a + b * b), phase_degrees(b, a)


# ---- datums ----


def daily_extrema(series: DataFrame, value: str = "height_m") -> DataFrame:
    """Highest and lowest per port and model day (partial days included)."""
    day = F.floor(hours_since(F.col("datetime_ist")) / 24).cast("long")
    return series.groupBy("port", day.alias("day")).agg(F.max(value).alias("high"), F.min(value).alias("low"), F.sum(value).alias("sum"), F.count(value).alias("n"))


def datums(series: DataFrame, value: str = "height_m", spring_percentile: float = 10.0) -> DataFrame:
    """HAT, MHWS, MHW, MSL, MLW, MLWS, LAT, RA per port; exact percentiles over the daily extrema.

    The series is reduced to days once; everything else works on that table.
    """
    days = daily_extrema(series, value)
    p = spring_percentile / 100.0
    cut = days.groupBy("port").agg(
        F.max("high").alias("HAT"), F.avg("high").alias("MHW"), (F.sum("sum") / F.sum("n")).alias("MSL"), F.avg("low").alias("MLW"), F.min("low").alias("LAT"),
        F.percentile("high", F.lit(1 - p)).alias("__hi"), F.percentile("low", F.lit(p)).alias("__lo"),
    )
    spring = days.join(cut.select(F.col("port").alias("__port"), "__hi", "__lo"), F.col("port") == F.col("__port")).groupBy("port").agg(F.avg(F.when(F.col("high") >= F.col("__hi"), F.col("high"))).alias("MHWS"), F.avg(F.when(F.col("low") <= F.col("__lo"), F.col("low"))).alias("MLWS"))
    return cut.join(spring, "port").select("port", "HAT", "MHWS", "MHW", "MSL", "MLW", "MLWS", "LAT", (F.col("HAT") - F.col("LAT")).alias("RA"))


# ---- nodal corrections (published equilibrium formulae for the main lunar constituents) ----


#: Published equilibrium series. Of the node's longitude N: the amplitude factor is the sum of
#: f[k] cos(k N), raised to ``power``; the phase shift in degrees is the sum of u[k] sin(k N).
NODAL_SERIES = {
    "M2": ((1.0004, -0.0373, 0.0002), (0.0, -2.14, 0.0), 1),
    "N2": ((1.0004, -0.0373, 0.0002), (0.0, -2.14, 0.0), 1),
    "2N2": ((1.0004, -0.0373, 0.0002), (0.0, -2.14, 0.0), 1),
    "MS4": ((1.0004, -0.0373, 0.0002), (0.0, -2.14, 0.0), 1),
    "M4": ((1.0004, -0.0373, 0.0), (0.0, -4.28, 0.0), 2),
    "MN4": ((1.0004, -0.0373, 0.0), (0.0, -4.28, 0.0), 2),
    "M6": ((1.0004, -0.0373, 0.0), (0.0, -6.42, 0.0), 3),
    "K2": ((1.0241, 0.2863, 0.0083), (0.0, -17.74, 0.68), 1),
    "K1": ((1.0060, 0.1150, -0.0088), (0.0, -8.86, 0.68), 1),
    "O1": ((1.0089, 0.1871, -0.0147), (0.0, 10.80, -1.34), 1),
    "Q1": ((1.0089, 0.1871, -0.0147), (0.0, 10.80, -1.34), 1),
    "Mf": ((1.0429, 0.4135, 0.0), (0.0, -23.74, 2.68), 1),
    "Mm": ((1.0, -0.1300, 0.0), (0.0, 0.0, 0.0), 1),
}
NODAL_COVERED = tuple(NODAL_SERIES)
#: Longitude of the moon's ascending node in degrees at the epoch less half a day, and its loss a day.
NODE_AT_EPOCH, NODE_PER_DAY = 125.0445, 0.0529539


def lunar_node(t: np.ndarray) -> np.ndarray:
    """Longitude of the moon's ascending node in radians, t hours since the epoch (linear mean motion)."""
    return np.radians(NODE_AT_EPOCH - NODE_PER_DAY * (t / 24.0 - 0.5))


def nodal_factors(name: str, t: np.ndarray) -> tuple[np.ndarray | float, np.ndarray | float]:
    """(amplitude factor f, phase shift u in radians). Constituents without a formula here return (1, 0)."""
    if name not in NODAL_SERIES:
        return 1.0, 0.0
    f, u, power = NODAL_SERIES[name]
    n = lunar_node(t)
    return sum(c * np.cos(k * n) for k, c in enumerate(f)) ** power, np.radians(sum(c * np.sin(k * n) for k, c in enumerate(u)))


def nodal_columns(name: str, t: Column) -> tuple[Column, Column]:
    """As ``nodal_factors``, as expressions of a column of hours."""
    if name not in NODAL_SERIES:
        return F.lit(1.0), F.lit(0.0)
    f, u, power = NODAL_SERIES[name]
    n = F.radians(F.lit(NODE_AT_EPOCH) - F.lit(NODE_PER_DAY) * (t / 24.0 - 0.5))
    total = sum((F.lit(c) * F.cos(k * n) for k, c in enumerate(f) if k and c), F.lit(f[0]))
    return (F.pow(total, F.lit(float(power))) if power > 1 else total), F.radians(sum((F.lit(c) * F.sin(k * n) for k, c in enumerate(u) if c), F.lit(0.0)))
