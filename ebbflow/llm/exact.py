"""Operator 9, exact dedup on a persistent digest index (native: DataFrame functions only).

The index is a table bucketed and sorted by digest. A batch is reduced to one winner per digest by
two-phase aggregates, held against the index by a sort-merge anti-join (bucket by bucket), and the new digests
are appended. Later batches thus lose to texts already stored. Only (digest, id, length) rows move; texts are
read where they lie, and the rows that stay are found by a join with their short keys.

Every index row names its batch. A batch that is given a name may be tried again: what its own earlier attempt
appended counts as unseen, so a driver lost between the append and the saving of the rows loses nothing.
``compact`` rewrites the index as one sorted file a bucket after many appends.

Two texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. Of equal texts of a batch the
one with the most code points stays, then the smallest id. Defined edge cases: null text is the
empty text; a null id loses to any other and may be ``keep_id`` only when all ids of the group are
null; rows repeated with the same id and text are all marked kept by ``assign`` (one of them is
returned by ``drop_copies``); an empty table gives an empty result; other columns are untouched.

A group may hold a third of all rows: the aggregates combine it map-side, and in the join back
the group's rows are the streamed side of a sort-merge join, which adaptive execution splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, checkpointed, compact, free_names, small_side

INDEX_SCHEMA = "digest binary, keep_id long, keep_chars int, batch string"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _text_keys(text: Column) -> list[Column]:
    """128 bits that tell a whole text (white space included) from others."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


class DigestIndex:
    """A catalog table (digest, keep_id, keep_chars, batch), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        if not self.exists():
            if spark.catalog.tableExists(self._moving):  # a compaction ended between its drop and its rename
                spark.sql(f"ALTER TABLE {self._moving} RENAME TO {name}")
            else:
                self._save(spark.createDataFrame([], INDEX_SCHEMA), name)

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int = 64) -> DigestIndex:
        """An empty index under a new name; ``drop`` removes it."""
        return cls(spark, f"digest_index_{uuid.uuid4().hex[:12]}", buckets)

    @property
    def _moving(self) -> str:
        return f"{self.name}_compacted"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _save(self, rows: DataFrame, name: str) -> None:
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(name)

    def compact(self) -> None:
        """One sorted file a bucket. The old table goes only once the new one is complete."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._moving}")
        self._save(self.read().repartition(self.buckets, "digest"), self._moving)
        self.drop()
        self.spark.sql(f"ALTER TABLE {self._moving} RENAME TO {self.name}")

    def unseen(self, winners: DataFrame, batch: str) -> DataFrame:
        """The winners whose digest no other batch stored: sort-merge anti-join on the bucket key."""
        known = self.read().where(F.col("batch") != batch).select("digest")
        return winners.join(known.hint("merge"), "digest", "left_anti")

    def _append(self, winners: DataFrame, batch: str, retried: bool) -> None:
        """Adds the winners that the index lacks; a retried batch leaves its earlier rows as they are."""
        rows = winners.select("digest", "keep_id", "keep_chars", F.lit(batch).alias("batch"))
        if retried:
            rows = rows.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._save(rows.repartition(self.buckets, "digest"), self.name)

    def _take(self, winners: DataFrame, batch: str | None) -> DataFrame:
        """The batch's unseen winners (checkpointed), after their append."""
        name = batch or uuid.uuid4().hex
        new = checkpointed(self.unseen(winners, name))
        self._append(new, name, batch is not None)
        return new

    def assign(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Adds a batch and returns a row per document: doc_id, keep_id, group_size, kept, digest."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        marks = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), F.char_length(text).alias("n_chars")))
        # bitwise NOT reverses the order of ids without overflow
        winners = marks.groupBy("digest").agg(F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("inverse"))).alias("best"), F.count("*").alias("group_size"))
        winners = compact(winners.select("digest", F.bitwise_not("best.inverse").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "group_size"), 100_000, marks.count())
        self._take(winners, batch)
        stored = checkpointed(winners.select("digest", "group_size").join(self.read().select("digest", "keep_id").hint("merge"), "digest"))
        joined = marks.join(stored.hint("merge"), "digest")
        return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")

    def drop_copies(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, broadcast_rows: int = 200_000) -> DataFrame:
        """``docs`` without copies (within the batch, or of stored texts), same columns.

        Digests decide. The rows that go, or if they are fewer the rows that stay, are then named by id and
        128 bits of the text, and one join with that table filters ``docs``: a broadcast of at most
        ``broadcast_rows`` keys of 24 bytes, beyond that a shuffle join.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        i, a, b = free_names(docs.columns, "__id", "__k1", "__k2")
        key = [x.alias(n) for x, n in zip([F.col(id_col).cast("long"), *_text_keys(text)], (i, a, b), strict=True)]
        marks = checkpointed(docs.select(*key, digest(text).alias("digest"), F.char_length(text).alias("n_chars")))
        rows = marks.groupBy("digest", "n_chars", i, a, b).agg(F.count("*").alias("copies"))
        best = F.max(F.struct("n_chars", F.bitwise_not(i).alias("inverse"), a, b, "copies")).alias("best")
        winners = rows.groupBy("digest").agg(best, F.count("*").alias("texts"))
        winners = checkpointed(winners.select("digest", F.bitwise_not("best.inverse").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), F.col(f"best.{a}").alias(a), F.col(f"best.{b}").alias(b), F.col("best.copies").alias("copies"), "texts"))
        kept = self._take(winners, batch).select(F.col("keep_id").alias(i), a, b, "copies")
        names = [F.col(f"`{c}`") for c in docs.columns]
        same = lambda keys: docs[id_col].cast("long").eqNullSafe(keys[i]) & (_text_keys(F.coalesce(docs[text_col], F.lit("")))[0] == keys[a]) & (_text_keys(F.coalesce(docs[text_col], F.lit("")))[1] == keys[b])
        whole, repeated = kept.where("copies = 1").drop("copies"), kept.where("copies > 1").drop("copies")
        n_whole, n_rows = whole.count(), marks.select(i, a, b).count()
        if n_whole <= n_rows - n_whole:
            once = docs.join(small_side(whole, n_whole, broadcast_rows), same(whole), "left_semi")
        else:
            gone = checkpointed(marks.select(i, a, b).join(whole.hint("merge"), [marks[i].eqNullSafe(whole[i]), marks[a] == whole[a], marks[b] == whole[b]], "left_anti").distinct())
            once = docs.join(small_side(gone, gone.count(), broadcast_rows), same(gone), "left_anti")
        # rows that the batch repeats with id and text: one of each, by an order over their other columns
        if repeated.isEmpty():
            return once.select(*names)
        again = docs.join(small_side(repeated, repeated.count(), broadcast_rows), same(repeated))
        plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        single = again.groupBy(i, a, b).agg(F.max_by(F.struct(*names), F.xxhash64(*[F.col(f"`{c}`") for c in plain])).alias("row"))
        return once.select(*names).unionByName(single.select("row.*"))
