"""The training-data pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them back for
the next one, so no stage's lineage reaches into another's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbflow.llm import exact, mixing, near, packing, quality
from ebbflow.llm.common import prepare, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    prepare(spark)
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    index = exact.DigestIndex.fresh(spark)
    kept = index.drop_copies(docs)
    index.drop()  # the rows are named by now
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    prepare(spark)
    return near.drop_near_copies(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the rates that bring domain totals to their target weights."""
    prepare(spark)
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing to target weights", mixing_to_targets),
    ("packing", mixture_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs


#: Packing needs a tokenizer and mixing a fitted classifier: SQL can't express them.
ORACLE_SQL = None
