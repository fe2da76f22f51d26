"""Prominent peaks and event matching: the two steps whose order matters, on reduced rows.

Peaks: runs of equal heights collapse and only local extrema (with the least sample of the valley beside
each) leave the JVM; the greedy distance rule and prominence then work on that small table per
(port, block, polarity). Matching: greedy in time order per (port, state), cut where no candidate can
reach across.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros_between, shift_micros, vertex
from .series import gap_blocks

PROMINENCE_M = 0.5
SEPARATION_HOURS = 4
MATCH_MINUTES = 180


def find_peaks(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Indices of peaks of a whole block (reference form of the kernel, used by tests and small callers).

    Plateaus give their floor midpoint; block ends never count. Distance is enforced by height first, then
    prominence on the whole block. Equal heights: the later one is visited first.
    """
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    at = np.array(found, int)
    at = at[keep_apart(at, x[at], distance)] if len(at) else at
    kept = []
    for p in at:
        lo = p
        left = x[p]
        while lo >= 0 and x[lo] <= x[p]:
            left = min(left, x[lo])
            lo -= 1
        hi = p
        right = x[p]
        while hi < len(x) and x[hi] <= x[p]:
            right = min(right, x[hi])
            hi += 1
        if x[p] - max(left, right) >= prominence:
            kept.append(p)
    return np.array(kept, int)


def keep_apart(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Flags of peaks that survive the distance rule: from the highest down, a survivor removes nearer ones."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if keep[k]:
            lo = bisect.bisect_right(at, at[k] - distance)
            hi = bisect.bisect_left(at, at[k] + distance)
            for j in range(lo, hi):
                if j != k:
                    keep[j] = False
    return keep


def prominent(at: np.ndarray, height: np.ndarray, before: np.ndarray, after: np.ndarray, keep: np.ndarray, least: float) -> np.ndarray:
    """Flags by prominence. ``before`` / ``after``: least sample between a maximum and the one before / after it
    (or the block's end). All maxima stop a search, removed ones too."""
    n = len(at)

    def side(valley: np.ndarray, order: range, step: int) -> np.ndarray:
        low = np.empty(n)
        stack: list[tuple[float, float]] = []  # (height, least sample on its outer side up to a higher one)
        for k in order:
            m = valley[k]
            while stack and stack[-1][0] <= height[k]:
                m = min(m, stack.pop()[1])
            low[k] = m
            stack.append((height[k], m))
        return low

    left = side(before, range(n), 1)
    right = side(after, range(n - 1, -1, -1), -1)
    return keep & (height - np.maximum(left, right) >= least)


def _extrema(series: DataFrame, sign: int, step_minutes: int) -> DataFrame:
    """Local maxima of sign * height per (port, block) with their neighbours' heights and valley minima."""
    blocks = gap_blocks(series, step_minutes)
    key = Window.partitionBy("port", "block_id")
    w = key.orderBy("datetime_ist")
    x = blocks.withColumn("x", sign * F.col("height_m")).withColumn("idx", F.row_number().over(w) - 1).withColumn("size", F.count("*").over(key)).where("size >= 5")
    x = x.withColumn("p", F.lag("x").over(w)).withColumn("f", F.lead("x").over(w)).withColumn("hp", F.lag("height_m").over(w)).withColumn("hf", F.lead("height_m").over(w))
    # runs of equal heights
    x = x.withColumn("run", F.sum(F.when(F.col("p") == F.col("x"), 0).otherwise(1)).over(w))
    rows = x.groupBy("port", "block_id", "run").agg(F.min("idx").alias("i"), F.max("idx").alias("j"), F.first("x").alias("x"), F.min_by("p", "idx").alias("p"), F.max_by("f", "idx").alias("f"), F.collect_list(F.struct("idx", "datetime_ist", "height_m", "hp", "hf")).alias("rows"))
    rw = Window.partitionBy("port", "block_id").orderBy("run")
    peak = (F.col("p") < F.col("x")) & (F.col("f") < F.col("x"))
    rows = rows.withColumn("peak", F.coalesce(peak, F.lit(False))).withColumn("ordinal", F.sum(F.col("peak").cast("int")).over(rw))
    # least sample before the first, between two, and after the last maximum
    valley = rows.groupBy("port", "block_id", "ordinal").agg(F.min("x").alias("low"))
    nxt = valley.select("port", "block_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("low").alias("before"))
    mid = F.floor((F.col("i") + F.col("j")) / 2)
    at = F.filter("rows", lambda r: r["idx"] == mid)[0]
    peaks = rows.where("peak").select("port", "block_id", "ordinal", "x", at.alias("at"))
    # the valley after a maximum includes the maximum itself as its first run: harmless, as it is higher
    out = peaks.join(nxt, ["port", "block_id", "ordinal"]).join(valley.withColumnRenamed("low", "after"), ["port", "block_id", "ordinal"])
    return out.select("port", "block_id", F.lit(sign).alias("sign"), F.col("at.idx").cast("long").alias("idx"), "x", "before", "after", F.col("at.datetime_ist").alias("datetime_ist"), F.col("at.height_m").alias("height_m"), F.col("at.hp").alias("hp"), F.col("at.hf").alias("hf"))


_CANDIDATE = "port string, block_id long, sign int, idx long, x double, before double, after double, datetime_ist timestamp_ntz, height_m double, hp double, hf double"


def prominent_events(series: DataFrame, step_minutes: int = 60, prominence: float = PROMINENCE_M, separation_hours: float = SEPARATION_HOURS) -> DataFrame:
    """port, state, datetime_ist, height_m of the prominent turning points, refined by a parabola.

    An empty series gives an empty result.
    """
    distance = max(1, round(separation_hours * 60 / step_minutes))
    found = _extrema(series, 1, step_minutes).unionByName(_extrema(series, -1, step_minutes))

    def kernel(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("idx")
        keep = keep_apart(df["idx"].to_numpy(), df["x"].to_numpy(), distance)
        return df[prominent(df["idx"].to_numpy(), df["x"].to_numpy(), df["before"].to_numpy(), df["after"].to_numpy(), keep, prominence)]

    kept = found.groupBy("port", "block_id", "sign").applyInPandas(kernel, _CANDIDATE)
    offset, height = vertex(F.col("hp"), F.col("height_m"), F.col("hf"))
    return kept.select("port", F.when(F.col("sign") > 0, "High").otherwise("Low").alias("state"), shift_micros(F.col("datetime_ist"), F.round(offset * (step_minutes * 60_000_000))).alias("datetime_ist"), height.alias("height_m"))


# ---- matching ----

MATCH_SCHEMA = "port string, state string, predicted_index long, observed_datetime_ist timestamp_ntz, predicted_datetime_ist timestamp_ntz, time_error_minutes double, observed_height_m double, predicted_height_m double, height_error_m double"


def match_greedy(obs: list[tuple[int, float]], pred: list[tuple[int, float, int]], most: int | None) -> list[tuple[int, int]]:
    """(observed position, predicted position) pairs: observed in time order take the nearest unused prediction
    within ``most`` microseconds; ties go to the lowest index. pred: (time, height, index) sorted by (time, index).

    Used predictions are skipped by union-find links, so a search touches each at most once more.
    """
    times = [p[0] for p in pred]
    n = len(pred)
    right, left = list(range(n + 1)), list(range(-1, n))

    def up(k: int) -> int:
        while right[k] != k:
            right[k] = right[right[k]]
            k = right[k]
        return k

    def down(k: int) -> int:  # k + 1 shifted: left[k + 1] is k while unused
        while k >= 0 and left[k + 1] != k:
            left[k + 1] = left[left[k + 1] + 1]
            k = left[k + 1]
        return k

    out = []
    for o, (t, _) in enumerate(obs):
        at = bisect.bisect_left(times, t)
        hi, lo = up(at), down(at - 1)
        options = []
        if hi < n:
            options.append((times[hi] - t, pred[hi][2], hi))
        while lo >= 0:
            options.append((t - times[lo], pred[lo][2], lo))
            nxt = down(lo - 1)
            if nxt < 0 or times[nxt] != times[lo]:
                break
            lo = nxt
        if options:
            best = min(options)
            if most is None or best[0] <= most:
                out.append((o, best[2]))
                right[best[2]], left[best[2] + 1] = best[2] + 1, best[2] - 1
    return out


def match_events(observed: DataFrame, predicted: DataFrame, max_minutes: float | None = MATCH_MINUTES) -> DataFrame:
    """One-to-one greedy matches (MATCH_SCHEMA), per port and state.

    With a limit, histories are cut wherever consecutive events of either kind lie further apart than
    the limit: no match crosses such a gap, so a long series becomes many small groups.
    """
    most = None if max_minutes is None else int(max_minutes * 60_000_000)
    index = F.row_number().over(Window.partitionBy("port").orderBy("datetime_ist", "state", "height_m")) - 1
    pred = predicted.select("port", "state", "datetime_ist", "height_m", (F.col("predicted_index") if "predicted_index" in predicted.columns else index).cast("long").alias("predicted_index"), F.lit(1).alias("kind"))
    both = observed.select("port", "state", "datetime_ist", "height_m", F.lit(None).cast("long").alias("predicted_index"), F.lit(0).alias("kind")).unionByName(pred)
    w = Window.partitionBy("port", "state").orderBy("datetime_ist", "kind")
    if most is None:
        both = both.withColumn("part", F.lit(0).cast("long"))
    else:
        far = micros_between(F.lag("datetime_ist").over(w), F.col("datetime_ist")) > most
        both = both.withColumn("__far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("part", F.sum("__far").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__far")

    def kernel(df: pd.DataFrame) -> pd.DataFrame:
        df = df.assign(us=df["datetime_ist"].to_numpy().astype("datetime64[us]").astype("int64"))
        o = df[df["kind"] == 0].sort_values(["us", "height_m"])
        p = df[df["kind"] == 1].sort_values(["us", "predicted_index"])
        pairs = match_greedy(list(zip(o["us"], o["height_m"], strict=True)), list(zip(p["us"], p["height_m"], p["predicted_index"].astype("int64"), strict=True)), most)
        a, b = o.iloc[[x for x, _ in pairs]], p.iloc[[y for _, y in pairs]]
        return pd.DataFrame({
            "port": a["port"].to_numpy(), "state": a["state"].to_numpy(), "predicted_index": b["predicted_index"].astype("int64").to_numpy(), "observed_datetime_ist": a["datetime_ist"].to_numpy(), "predicted_datetime_ist": b["datetime_ist"].to_numpy(),
            "time_error_minutes": (b["us"].to_numpy() - a["us"].to_numpy()) / 6e7, "observed_height_m": a["height_m"].to_numpy(), "predicted_height_m": b["height_m"].to_numpy(), "height_error_m": b["height_m"].to_numpy() - a["height_m"].to_numpy(),
        })

    return both.groupBy("port", "state", "part").applyInPandas(kernel, MATCH_SCHEMA)
