"""Operator 6, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z in lower case, of the whole text. A text's features are the
distinct hashes of its words (the lower quarter of ``dims`` numbers), of neighbouring word pairs and
of pairs with one word between (the rest). Training uses at most ``most_rows`` labelled texts (the bound is this parameter; rows are drawn
by a hash of the id) split by that hash over ``shards`` tasks. Each runs FTRL-proximal with
per-coordinate rates and L1 from zero; their weights are averaged, and since averaging shrinks what
only some shards found, one scale and the bias are refitted on the same rows. L1 leaves a sparse table of
(feature, weight), at most ``dims`` entries of 12 bytes, which is broadcast to score all texts in one
Arrow pass without a shuffle.

Labels are read only where crc32(doc_id as text) mod 5 is not 0; id, language, source and label are never
inputs of a score. Edge cases: null and blank texts score by the bias alone; a null id isn't held
out and never trained on; labels that are null or lack a text are ignored, several labels of one id
count as their maximum; without any usable label every score is 0.5 of an untrained model (predicted 1);
repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written
from .wordhash import Chunk, chunks, mix64

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class FtrlConfig:
    dims: int = 1 << 20
    pair_value: float = 0.2  # value of a pair feature; a word's is 1. Below 1 it keeps rare pairs from standing in for words
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 6
    shards: int = 1
    most_rows: int = 16_000
    folds: int = 5  # rows whose crc32 of the id is 0 modulo this are held out


def _features(c: Chunk, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows + 1 offsets, feature numbers), distinct within a row."""
    words = np.uint64(dims // 4)
    parts, docs = [c.word % words], [c.doc]
    for gap, salt in ((1, np.uint64(0x9E37)), (2, np.uint64(0x79B9))):
        if len(c.word) > gap:
            same = c.doc[:-gap] == c.doc[gap:]
            pair = mix64(c.word[:-gap] * np.uint64(0xD6E8FEB86659FD93) + c.word[gap:] + salt)[same]
            parts.append(words + pair % (np.uint64(dims) - words))
            docs.append(c.doc[:-gap][same])
    code = np.concatenate(docs).astype(np.uint64) * np.uint64(dims) + np.concatenate(parts)
    code = np.unique(code)
    doc = code // np.uint64(dims)
    return np.searchsorted(doc, np.arange(c.rows + 1, dtype=np.uint64)), (code % np.uint64(dims)).astype(np.int64)


def values(features: np.ndarray, cfg: FtrlConfig) -> np.ndarray:
    return np.where(features < cfg.dims // 4, 1.0, cfg.pair_value)


def train(rows: list[tuple[np.ndarray, int]], cfg: FtrlConfig) -> np.ndarray:
    """FTRL-proximal over (features, label) in the given order; dims + 1 weights, the bias last (no L1)."""
    z, n = np.zeros(cfg.dims + 1), np.zeros(cfg.dims + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * cfg.l1) / ((cfg.beta + np.sqrt(n[at])) / cfg.alpha + cfg.l2)
        w[np.abs(zi) <= cfg.l1] = 0.0
        w[-1] = -zi[-1] / ((cfg.beta + np.sqrt(n[at[-1]])) / cfg.alpha + cfg.l2)
        return w

    for _ in range(cfg.epochs):
        for features, label in rows:
            at = np.append(features.astype(np.int64), cfg.dims)
            x = np.append(values(features, cfg), 1.0)
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / cfg.alpha * w
            n[at] = grown
    return weights(np.arange(cfg.dims + 1))


def _feature_rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for c in chunks(batch.column("text"), lower=True, separators=_SEPARATOR):
            offsets, f = _features(c, dims)
            out += [f[offsets[k] : offsets[k + 1]].astype(np.uint32).tobytes() for k in range(c.rows)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("shard", "draw", "label")), pa.array(out, pa.binary())], ["shard", "draw", "label", "features"])


def _train_shard(group: pa.Table, cfg: FtrlConfig) -> pa.Table:
    group = group.sort_by([("draw", "ascending"), ("label", "ascending"), ("features", "ascending")])
    rows = [(np.frombuffer(f.as_buffer(), np.uint32), int(y)) for f, y in zip(group.column("features"), group.column("label").to_pylist(), strict=True)]  # views, no copies
    w = train(rows, cfg)
    at = np.nonzero(w)[0]
    return pa.table({"feature": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})


def held_out(id_col: Column, cfg: FtrlConfig = FtrlConfig()) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % cfg.folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, cfg: FtrlConfig = FtrlConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[int, float]:
    """The sparse weights (feature -> weight; ``dims`` is the bias)."""
    marked = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("label")).where("l_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("l_id"), cfg))
    sample = marked.groupBy("l_id").agg(F.max("label").alias("label")).withColumn("draw", F.xxhash64("l_id")).orderBy("draw", "l_id").limit(cfg.most_rows)
    sample = checkpointed(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))  # most_rows rows at most
    slim = texts.select(F.pmod("draw", F.lit(cfg.shards)).cast("int").alias("shard"), "draw", "label", "text")
    rows = written(slim.mapInArrow(lambda it: _feature_rows(it, cfg.dims), "shard int, draw long, label int, features binary"), "features")
    # group sizes are bounded by most_rows; texts of the same id (repeated rows) train once each
    weights = rows.groupBy("shard").applyInArrow(lambda t: _train_shard(t, cfg), "feature long, weight double")
    shards = F.lit(float(cfg.shards))
    averaged = {r.feature: r.weight for r in weights.groupBy("feature").agg((F.sum("weight") / shards).alias("weight")).collect()}  # dims + 1 rows at most
    at = np.array(sorted(averaged), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((at, np.array([averaged[k] for k in at.tolist()])))
    margins = rows.mapInArrow(lambda it: _margins(it, shared, cfg), "margin double, label int").collect()  # most_rows rows at most
    scale, bias = calibrate(np.array([r.margin for r in margins]), np.array([r.label for r in margins], float))
    return {k: w * scale for k, w in averaged.items() if k != cfg.dims} | {cfg.dims: bias}


def calibrate(margin: np.ndarray, label: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """(scale, bias) of a logistic fit of the label on the margin, by damped Newton steps."""
    if not len(label) or label.min() == label.max():
        return 1.0, float(np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5))) if len(label) else 0.0
    x, w = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - label) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _dense(shared, cfg: FtrlConfig) -> np.ndarray:
    """Weight times value of every feature; the bias last."""
    at, weights = shared.value
    table = np.zeros(cfg.dims + 1)
    table[at] = weights
    table[: cfg.dims] *= values(np.arange(cfg.dims), cfg)
    return table


def _margins(batches: Iterator[pa.RecordBatch], shared, cfg: FtrlConfig) -> Iterator[pa.RecordBatch]:
    table = _dense(shared, cfg)
    for batch in batches:
        margin = [float(table[np.frombuffer(f, np.uint32)].sum()) for f in batch.column("features").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(margin, pa.float64()), batch.column("label")], ["margin", "label"])


def _score(batches: Iterator[pa.RecordBatch], shared, cfg: FtrlConfig) -> Iterator[pa.RecordBatch]:
    table = _dense(shared, cfg)
    for batch in batches:
        scores = []
        for c in chunks(batch.column("text"), lower=True, separators=_SEPARATOR):
            offsets, f = _features(c, cfg.dims)
            total = np.concatenate([[0.0], np.cumsum(table[f])])
            margin = total[offsets[1:]] - total[offsets[:-1]] + table[cfg.dims]
            scores.append(1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))))
        score = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, weights: dict[int, float], cfg: FtrlConfig = FtrlConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    at = np.array(sorted(weights), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((at, np.array([weights[k] for k in at.tolist()])))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long"), cfg).alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda it: _score(it, shared, cfg), "doc_id long, held_out boolean, score double, predicted int")
