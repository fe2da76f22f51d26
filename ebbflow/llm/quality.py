"""Operator 4, quality rules: adaptive thresholds from mergeable quantile sketches.

Each document gets exact counts over its whole text (one Arrow pass). Four ratios of them feed one
log-bucket quantile sketch per (language, source, ratio): the sketch is a table of bucket counts, so
partial sketches merge by addition and Spark's own two-phase aggregation builds them. From each
sketch come a median and an upper quartile; a document is rejected where a ratio lies beyond
``upper + FENCE * (upper - median)``, widened by an absolute slack, so a clean stratum loses nothing.
Strata with fewer than ``min_rows`` rows use the merged sketch of their language, then of everything.
Where a stratum's upper quartile lies beyond the merged fence but its median doesn't, over a quarter of it is
junk and its own scale is the junk's: the merged fence holds (a language's is checked in the same way).

Defined edge cases: null text has no words (``base_failed``); null language or source is a stratum of
its own; repeated rows are judged alike, each on its own; an empty table gives an empty result;
columns beyond id, text, language and source are ignored by the rules and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, column_or_null, small_side
from .wordhash import chunks, range_hash, sums

#: Characters counted as symbols (fixed values of the contract).
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """A ratio, judged above its fence; ``slack`` is the least distance from the upper quartile."""

    name: str
    top: str
    bottom: str
    slack: float


@dataclass(frozen=True)
class QualityConfig:
    rules: tuple[Rule, ...] = (
        Rule("symbols_per_word", "n_symbols", "n_words", 0.2),
        Rule("chars_per_word", "word_chars", "n_words", 4.0),
        Rule("dup_lines_per_line", "n_dup_lines", "n_lines", 0.5),
        Rule("repeats_per_word", "n_repeat_words", "n_words", 0.4),
    )
    growth: float = 1.02  # relative width of a sketch bucket
    upper: float = 0.75
    fence: float = 6.0
    min_rows: int = 200
    broadcast_rows: int = 200_000  # thresholds beyond this many strata are joined by shuffle


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _counts(batches: Iterator[pa.RecordBatch], text: str = "text", carry: tuple[str, ...] = ("doc_id", "lang", "source"), prefix: str = "") -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    for batch in batches:
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for c in chunks(batch.column(text)):
            n_words = c.n_words()
            lead = (c.data & 0xC0) != 0x80
            word_chars = sums(lead & ~c.space, c.offsets)
            n_symbols = sums(symbol[c.data], c.offsets)
            # lines: cut at \n and at row borders
            cut = np.nonzero(c.data == 10)[0]
            start = np.sort(np.concatenate([cut + 1, c.offsets[:-1]]))
            end = np.sort(np.concatenate([cut, c.offsets[1:]]))
            with_word = sums(~c.space, np.append(start, len(c.data))) > 0  # a line break is white space
            start, end = start[with_word], end[with_word]
            doc = np.searchsorted(c.offsets, start, "right") - 1
            n_lines = np.bincount(doc, minlength=c.rows)
            h = range_hash(c.data, start, end)
            order = np.lexsort((h, doc))
            same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            n_dup = np.bincount(doc[order][1:][same], minlength=c.rows)
            # words in 3-word windows that occur again
            at, g = c.grams(3)
            gdoc = c.doc[at]
            order = np.lexsort((g, gdoc))
            same = (g[order][1:] == g[order][:-1]) & (gdoc[order][1:] == gdoc[order][:-1])
            again = np.zeros(len(at), bool)
            again[1:] |= same
            again[:-1] |= same
            mark = np.zeros(len(c.word), bool)
            first = at[order[again]]
            for k in range(3):
                mark[first + k] = True
            n_repeat = np.bincount(c.doc[mark], minlength=c.rows)
            for k, v in enumerate((n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines)):
                cols[k].append(v)
        values = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64()) for v in cols]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in carry] + values, [*carry, *(prefix + k for k in COUNTS)])


def with_counts(docs: DataFrame, text_col: str, carry: list[str], prefix: str = "") -> DataFrame:
    """The columns ``carry`` of ``docs``, and exact counts over each whole text."""
    schema = T.StructType([docs.schema[k] for k in carry] + [T.StructField(prefix + k, T.LongType()) for k in COUNTS])
    return docs.mapInArrow(lambda batches: _counts(batches, text_col, tuple(carry), prefix), schema)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts and its stratum."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), column_or_null(docs, "lang", "string").alias("lang"), column_or_null(docs, "source", "string").alias("source"), F.col(text_col).alias("text"))
    return with_counts(slim, "text", ["doc_id", "lang", "source"])


def _ratio(rule: Rule, prefix: str = "") -> Column:
    top, bottom = F.col(prefix + rule.top), F.col(prefix + rule.bottom)
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _bucket(x: Column, growth: float) -> Column:
    """Log bucket of 1 + x; 0 stays 0. A bucket's upper edge stands for its values."""
    return F.ceil(F.round(F.log(1.0 + x) / float(np.log(growth)), 9)).cast("long")


def sketches(counts: DataFrame, cfg: QualityConfig) -> DataFrame:
    """(lang, source, rule, bucket, n) over documents with words: the mergeable quantile sketches."""
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), _bucket(_ratio(r), cfg.growth).alias("bucket")) for r in cfg.rules])).alias("r")
    return counts.where("n_words > 0").select("lang", "source", rules).groupBy("lang", "source", F.col("r.rule").alias("rule"), F.col("r.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], cfg: QualityConfig) -> DataFrame:
    """A row per key and rule: rows seen, and the fence read off the sketch.

    The window runs over buckets (at most some hundreds per key and rule), not over documents.
    """
    from pyspark.sql import Window

    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "rule")
    run = merged.select("*", F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("total"))
    value = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.pow(F.lit(cfg.growth), F.col("bucket")) - 1.0))
    read = run.groupBy(*keys, "rule").agg(F.max("total").alias("total"), value(0.5).alias("mid"), value(cfg.upper).alias("up"))
    slack = F.create_map(*[F.lit(x) for r in cfg.rules for x in (r.name, r.slack)])[F.col("rule")]
    return read.select(*keys, "rule", "total", "mid", "up", (F.col("up") + F.greatest(cfg.fence * (F.col("up") - F.col("mid")), slack)).alias("fence"))


def thresholds(counts: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """(lang, source, one fence column per rule), small strata backed by their language's or the global sketch."""
    sketch = checkpointed(sketches(counts, cfg).coalesce(64))  # some hundred rows a stratum and rule: few files
    own = _fences(sketch, ["lang", "source"], cfg)
    lang = _fences(sketch, ["lang"], cfg).select(F.col("lang").alias("l_lang"), F.col("rule").alias("l_rule"), F.col("total").alias("l_total"), F.col("mid").alias("l_mid"), F.col("up").alias("l_up"), F.col("fence").alias("l_own"))
    every = _fences(sketch, [], cfg).select(F.col("rule").alias("g_rule"), F.col("fence").alias("g_fence"))
    held = lambda mid, up, fence, bound: F.when((mid <= bound) & (up > bound), bound).otherwise(fence)
    wide = F.when(F.col("l_total") >= cfg.min_rows, held(F.col("l_mid"), F.col("l_up"), F.col("l_own"), F.col("g_fence"))).otherwise(F.col("g_fence"))
    best = F.when(F.col("total") >= cfg.min_rows, held(F.col("mid"), F.col("up"), F.col("fence"), F.least(wide, F.col("g_fence")))).otherwise(wide)
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule")), "left").join(F.broadcast(every), F.col("rule") == F.col("g_rule"), "left")
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r.name, best)).alias(f"max_{r.name}") for r in cfg.rules])


def _verdict(counts: DataFrame, fences: DataFrame, cfg: QualityConfig, prefix: str = "", lang: Column | None = None, source: Column | None = None) -> DataFrame:
    """``counts`` with ``base_failed`` and ``kept``, by the fences of each row's stratum."""
    names = [f"max_{r.name}" for r in cfg.rules]
    fences = fences.select(F.col("lang").alias("__t_lang"), F.col("source").alias("__t_source"), *[F.col(n).alias(f"__{n}") for n in names])
    lang, source = F.col("lang") if lang is None else lang, F.col("source") if source is None else source
    on = lang.eqNullSafe(F.col("__t_lang")) & source.eqNullSafe(F.col("__t_source"))
    joined = counts.join(small_side(fences, fences.count(), cfg.broadcast_rows), on, "left")
    n = lambda k: F.col(prefix + k)
    base = (n("n_words") < MIN_WORDS) | (100 * n("n_repeat_words") > 50 * n("n_words"))
    beyond = F.lit(False)
    for r in cfg.rules:
        beyond = beyond | F.coalesce(_ratio(r, prefix) > F.col(f"__max_{r.name}"), F.lit(False))
    return joined.withColumn(prefix + "base_failed", base).withColumn(prefix + "kept", ~base & ~beyond).drop("__t_lang", "__t_source", *[f"__{x}" for x in names])


def judge(docs: DataFrame, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``."""
    counts = checkpointed(text_counts(docs, id_col, text_col))
    return _verdict(counts, checkpointed(thresholds(counts, cfg).coalesce(16)), cfg)


def keep_good(docs: DataFrame, cfg: QualityConfig = QualityConfig(), text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows, same columns.

    A first pass settles the fences; the scan that keeps rows counts again beside the full row, so
    no text is shuffled or looked up by id, and rows with equal or null ids are judged each alone.
    """
    fences = checkpointed(thresholds(text_counts(docs.withColumn("__q_id", F.lit(0)), "__q_id", text_col), cfg).coalesce(16))
    counted = with_counts(docs, text_col, docs.columns, "__q_")
    judged = _verdict(counted, fences, cfg, "__q_", column_or_null(docs, "lang", "string"), column_or_null(docs, "source", "string"))
    return judged.where("__q_kept").select(*docs.columns)
