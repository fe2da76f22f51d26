"""Operator 3, MinHash near-dedup with b-bit signatures.

1. One Arrow pass hashes every distinct 5-word shingle of each whole text and takes ``n_hashes``
   minima; only the ``BITS`` low bits of each (after one mixing step, as low bits of a multiplicative hash are
   not even) are kept, packed as bit planes, beside one key per band.
2. Documents with the same shingle set (size and 128-bit digest) form one class; its smallest id
   stands for it, so copies never become pairs.
3. Per band bucket every member is paired with the bucket's smallest id. Pairs whose collision-corrected
   similarity (bit counts of the packed signatures) lies far below the threshold are dropped: ``margin``
   is six standard deviations of that estimate. The rest are confirmed on full shingle sets.
4. Components of the confirmed links. A group (a bucket's smallest id and all it was paired with) whose
   members are all in one component is done. In the others two more pivots a round, drawn by hash from
   the largest component and from the rest, meet the members of other components (``pivot_rounds``).
5. What still spans components is settled exactly: in each such group the members outside the largest
   component meet all members of other components in a join whose condition holds the bit-count test
   and then the full-set test, so refuted pairs never become rows. Members meet by size band (sets
   whose sizes differ by more than the threshold allows are never compared), and the join's buffered side is
   cut into blocks of ``block`` members. After this every candidate pair is confirmed, refuted or already
   connected; there is no cap on groups or partners.

Tables with a row or two per group are broadcast within ``broadcast_rows``; beyond that the join with a group's
members is dealt by group and ``salts`` salts, so a hot group is never one task's.

With ``rows_per_band`` 5 and 40 bands, a pair at similarity 0.75 shares no band with probability 2e-5.
Edge cases: null or blank text has an empty set, linked with nothing; a text of fewer than five
words is one shingle; a null id cannot represent a component: such a row takes its class's
component, or null; repeated rows share their fate; where one id stands on different texts, their links
are the id's links, and ``drop_near_copies`` keeps all rows of that id rather than lose a text; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, compact, free_names, small_side, written
from .components import connected_components
from .wordhash import chunks, mix64, shingle_sets

BITS = 4
_U32 = np.uint32


@dataclass(frozen=True)
class NearConfig:
    words: int = 5
    percent: int = 75  # 100 * intersection >= percent * union
    bands: int = 40
    rows_per_band: int = 5
    margin: float = 0.19
    pivot_rounds: int = 1
    block: int = 512
    seed: int = 20240229
    broadcast_rows: int = 200_000  # ids with at most ``bands`` hubs each: 70 MB at most, else a shuffle join
    salts: int = 16
    members: int = 256  # of a hub, in one part of the join that confirms its pairs

    @property
    def n_hashes(self) -> int:
        return self.bands * self.rows_per_band

    @property
    def lanes(self) -> int:
        """64-bit words of one bit plane."""
        return -(-self.n_hashes // 64)


SIGNATURE_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature array<long>"


def _arrays(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _signatures(batches: Iterator[pa.RecordBatch], cfg: NearConfig) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(cfg.seed)
    mult = rng.integers(0, 1 << 31, cfg.n_hashes).astype(_U32) * _U32(2) + _U32(1)
    add = rng.integers(0, 1 << 32, cfg.n_hashes).astype(_U32)
    salt1, salt2 = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
    for batch in batches:
        ids, at = batch.column("doc_id"), 0
        for c in chunks(batch.column("text"), lower=True):
            offsets, h = shingle_sets(c, cfg.words)
            n = np.diff(offsets)
            full = np.nonzero(n)[0]
            starts = offsets[:-1][full]
            minima = np.zeros((c.rows, cfg.n_hashes), _U32)
            d1, d2 = np.zeros(c.rows, np.uint64), np.zeros(c.rows, np.uint64)
            if len(full):
                h32 = (h >> np.uint64(32)).astype(_U32)
                for k in range(cfg.n_hashes):
                    minima[full, k] = np.minimum.reduceat(h32 * mult[k] + add[k], starts)
                d1[full] = np.add.reduceat(mix64(h ^ salt1), starts)
                d2[full] = np.add.reduceat(mix64(h + salt2), starts)
            bands = np.empty((c.rows, cfg.bands), np.uint64)
            for j in range(cfg.bands):
                key = np.full(c.rows, np.uint64(j + 1))
                for k in range(j * cfg.rows_per_band, (j + 1) * cfg.rows_per_band):
                    key = mix64(key ^ minima[:, k].astype(np.uint64)) + np.uint64(k)
                bands[:, j] = key
            mixed = (minima ^ (minima >> _U32(15))) * _U32(0x2C1B3C6D)
            low = (mixed ^ (mixed >> _U32(16))) & _U32((1 << BITS) - 1)
            planes = np.zeros((c.rows, BITS, cfg.lanes * 64), np.uint8)
            for b in range(BITS):
                planes[:, b, : cfg.n_hashes] = (low >> _U32(b)) & _U32(1)
            packed = np.packbits(planes, axis=2).view(np.uint64).reshape(c.rows, BITS * cfg.lanes)
            part = ids.slice(at, c.rows)
            at += c.rows
            yield pa.RecordBatch.from_arrays([part, pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _arrays(bands), _arrays(packed)], ["doc_id", "n_shingles", "d1", "d2", "bands", "signature"])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, cfg: NearConfig = NearConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set (d1, d2), band keys, packed b-bit signature."""
    return _slim(docs, id_col, text_col).mapInArrow(lambda it: _signatures(it, cfg), SIGNATURE_SCHEMA)


def estimate(a: Column, b: Column, cfg: NearConfig) -> Column:
    """Collision-corrected similarity of two packed signatures, from bit counts."""
    agree = F.lit(0)
    for lane in range(cfg.lanes):
        differ = F.lit(0).cast("long")
        for plane in range(BITS):
            k = plane * cfg.lanes + lane
            differ = differ.bitwiseOR(a[k].bitwiseXOR(b[k]))
        agree = agree + F.lit(64) - F.bit_count(differ)
    match = (agree - (cfg.lanes * 64 - cfg.n_hashes)) / float(cfg.n_hashes)
    chance = 2.0**-BITS
    return (match - chance) / (1.0 - chance)


def _possible(cfg: NearConfig, n1: str, n2: str, s1: str, s2: str) -> Column:
    """Sizes allow the threshold, and the estimate is not far below it."""
    sizes = 100 * F.least(n1, n2) >= cfg.percent * F.greatest(n1, n2)
    return sizes & (estimate(F.col(s1), F.col(s2), cfg) >= cfg.percent / 100 - cfg.margin)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for c in chunks(batch.column("text"), lower=True):
            offsets, h = shingle_sets(c, words)
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, c.rows), batch.column("hubs").slice(at, c.rows), sets], ["doc_id", "hubs", "shingles"])
            at += c.rows


def shingle_rows(docs: DataFrame, wanted: DataFrame, cfg: NearConfig) -> DataFrame:
    """(doc_id, hub, part, shingles): the full set of each document named by ``wanted`` (id, hub, part), once per row.

    Sets are hashed anew from the texts; a document has at most one hub per band.
    """
    rows = compact(wanted.groupBy(F.col("id").alias("w_id")).agg(F.collect_set(F.struct("hub", "part")).alias("hubs")))
    texts = docs.join(small_side(rows, rows.count(), cfg.broadcast_rows), docs["doc_id"] == rows["w_id"]).select("doc_id", "text", "hubs")
    sets = texts.mapInArrow(lambda it: _sets(it, cfg.words), "doc_id long, hubs array<struct<hub: long, part: int>>, shingles array<long>")
    return sets.select("doc_id", F.explode("hubs").alias("h"), "shingles").select("doc_id", "h.hub", "h.part", "shingles")


def _reaches(a: str, b: str, cfg: NearConfig) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return 100 * inter >= cfg.percent * (F.size(a) + F.size(b) - inter)


def confirm(docs: DataFrame, pairs: DataFrame, cfg: NearConfig) -> DataFrame:
    """Of ``pairs`` (id, hub), the links (u, v) whose full shingle sets reach the threshold.

    A member's set travels once per hub that it is held against; a hub's own set travels once per part of
    ``members`` of its members, so neither a set nor a hub's whole group meets in one task.
    """
    pairs = compact(pairs.select("id", "hub"))
    sizes = pairs.groupBy(F.col("hub").alias("g_hub")).agg(F.ceil(F.count("*") / cfg.members).cast("int").alias("parts"))
    members = _with_group(pairs, sizes, cfg).select("id", "hub", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    own = sizes.select(F.col("g_hub").alias("id"), F.col("g_hub").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = shingle_rows(docs, members.unionByName(own), cfg)
    hubs = sent.where("doc_id = hub").select(F.col("hub").alias("h"), F.col("part").alias("h_part"), F.col("shingles").alias("h_shingles"))
    met = sent.where("doc_id <> hub").join(hubs, (F.col("hub") == F.col("h")) & (F.col("part") == F.col("h_part")))
    return met.where(_reaches("shingles", "h_shingles", cfg)).select(F.col("doc_id").alias("u"), F.col("hub").alias("v"))


def _with_group(rows: DataFrame, groups: DataFrame, cfg: NearConfig) -> DataFrame:
    """``rows`` joined by ``hub`` with ``groups`` (a few rows per group, key g_hub)."""
    groups = checkpointed(groups)
    n = groups.count()
    if n <= cfg.broadcast_rows:
        return rows.join(F.broadcast(groups), F.col("hub") == F.col("g_hub")).drop("g_hub")
    salted = groups.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1))))
    salt = F.pmod(F.xxhash64("id"), F.lit(cfg.salts)).cast("int")
    return rows.join(salted, (F.col("hub") == F.col("g_hub")) & (salt == F.col("g_salt"))).drop("g_hub", "g_salt")


def _open_groups(groups: DataFrame, components: DataFrame, cfg: NearConfig) -> DataFrame:
    """Rows of the groups that span components, with ``comp`` and the group's largest component ``main``."""
    labelled = compact(groups.join(components, groups["id"] == components["node"], "left").select(*groups.columns, F.coalesce("component", "id").alias("comp")), 50_000, groups.count())
    parts = labelled.groupBy("hub", "comp").agg(F.count("*").alias("n"))
    spans = parts.groupBy(F.col("hub").alias("g_hub")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("n", "comp")).alias("largest"), F.sum("n").alias("group_rows"))
    return _with_group(labelled, spans.where("lo < hi").select("g_hub", F.col("largest.comp").alias("main"), "group_rows"), cfg)


def _pivot_pairs(opened: DataFrame, salt: int, cfg: NearConfig) -> DataFrame:
    """(id, hub): members against two pivots of their group, one inside and one outside its largest component."""
    drawn = F.struct(F.xxhash64("id", F.lit(salt)).alias("order"), "id", "comp", "n", "sig")
    pivots = opened.groupBy(F.col("hub").alias("g_hub"), (F.col("comp") == F.col("main")).alias("inside")).agg(F.min(drawn).alias("p"))
    met = _with_group(opened, pivots.select("g_hub", "p"), cfg).where(F.col("comp") != F.col("p.comp"))
    near = met.select("id", "n", "sig", F.col("p.id").alias("pivot"), F.col("p.n").alias("p_n"), F.col("p.sig").alias("p_sig")).where(_possible(cfg, "n", "p_n", "sig", "p_sig"))
    return near.select(F.greatest("id", "pivot").alias("id"), F.least("id", "pivot").alias("hub")).distinct()


def _blocks(rows: DataFrame, cfg: NearConfig) -> DataFrame:
    """With each row's size band, and the number of blocks of its group: linked sets lie at most one band apart."""
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(cfg.percent / 100)).cast("int")
    return rows.withColumn("size_band", band).withColumn("blocks", F.ceil(F.col("group_rows") / cfg.block).cast("int"))


def _meetings(rows: DataFrame, *more: Column) -> DataFrame:
    """A row of the group's smaller components for every block and size band in which it may find partners."""
    own = rows.select(F.col("hub").alias("a_hub"), F.col("id").alias("a"), F.col("comp").alias("a_comp"), F.col("n").alias("a_n"), F.col("sig").alias("a_sig"), *more, "blocks", "size_band")
    bands = own.withColumn("a_band", F.explode(F.sequence(F.col("size_band") - 1, F.col("size_band") + 1)))
    return bands.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "size_band")


def _settle(docs: DataFrame, opened: DataFrame, cfg: NearConfig) -> DataFrame:
    """The remaining links of groups that span components: exact, without a row per refuted pair."""
    blocked = _blocks(opened, cfg)
    minor = _meetings(blocked.where("comp <> main"))
    others = blocked.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    same = (F.col("a_hub") == F.col("hub")) & (F.col("a_block") == F.col("block")) & (F.col("a_band") == F.col("size_band"))
    apart = (F.col("a_comp") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("a") < F.col("id")))
    maybe = same & apart & _possible(cfg, "a_n", "n", "a_sig", "sig")
    likely = compact(minor.join(others, maybe, "left_semi").select(F.col("a_hub").alias("hub"), F.col("a").alias("id")).distinct())
    live = likely.select(F.col("hub").alias("g_hub")).distinct()
    rows = compact(_with_group(others, live, cfg))
    sets = shingle_rows(docs, rows.select("id", "hub", F.lit(0).alias("part")), cfg).select(F.col("doc_id").alias("s_id"), F.col("hub").alias("s_hub"), "shingles")
    full = rows.join(sets, (F.col("id") == F.col("s_id")) & (F.col("hub") == F.col("s_hub"))).drop("s_id", "s_hub")
    a = _meetings(full.join(likely, ["hub", "id"], "left_semi"), F.col("shingles").alias("a_shingles"))
    met = a.join(full, maybe & _reaches("a_shingles", "shingles", cfg))
    return met.select(F.greatest("a", "id").alias("u"), F.least("a", "id").alias("v")).distinct()


def near_components(docs: DataFrame, cfg: NearConfig = NearConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    return _components(docs, cfg, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _components(docs: DataFrame, cfg: NearConfig, id_col: str, text_col: str) -> DataFrame:
    """As near_components, with the digest (d1) of each row's set."""
    slim = _slim(docs, id_col, text_col)
    marks = written(signatures(docs, cfg, id_col, text_col), "signatures")
    classes = compact(marks.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")), most_rows=marks.count())
    reps = classes.where("rep IS NOT NULL").withColumnRenamed("rep", "doc_id")
    nodes = written(marks.join(reps, ["doc_id", "n_shingles", "d1", "d2"], "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "bands", "signature"), "nodes")

    # each member of a bucket of two or more, beside the bucket's smallest id
    rows = nodes.select("id", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("bucket", "hub")
    stars = compact(rows.join(buckets, "bucket").where("id <> hub").select("id", "hub").distinct())
    marks_of = nodes.select(F.col("id").alias("m_id"), F.col("n_shingles").alias("n"), F.col("signature").alias("sig"))
    own = stars.select(F.col("hub").alias("id"), "hub").distinct()
    groups = written(stars.unionByName(own).join(marks_of, F.col("id") == F.col("m_id")).drop("m_id"), "groups")

    heads = groups.where("id = hub").select(F.col("hub").alias("g_hub"), F.col("n").alias("h_n"), F.col("sig").alias("h_sig"))
    pairs = _with_group(groups.where("id <> hub"), heads, cfg).where(_possible(cfg, "n", "h_n", "sig", "h_sig"))
    links = compact(confirm(slim, pairs.select("id", "hub"), cfg))
    for salt in range(cfg.pivot_rounds):
        known = connected_components(links)
        met = compact(_pivot_pairs(compact(_open_groups(groups, known, cfg), 50_000, groups.count()), salt, cfg))
        links = compact(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(confirm(slim, met, cfg)))
    known = connected_components(links)
    opened = compact(_open_groups(groups, known, cfg), 50_000, groups.count())
    final = connected_components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(_settle(slim, opened, cfg)))

    of_class = classes.join(final, classes["rep"] == final["node"], "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    light = marks.select("doc_id", "n_shingles", "d1", "d2")
    joined = light.join(of_class, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", "n_shingles", "d1", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, cfg: NearConfig = NearConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, same columns. Rows with a null id, or with an id that
    stands on different texts, stay."""
    of_id = _components(docs, cfg, id_col, text_col).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.max("kept").alias("kept"))
    name = free_names(docs.columns, "__gone")[0]
    gone = checkpointed(of_id.where("lo = hi AND NOT kept").select(F.col("doc_id").alias(name)))
    return docs.join(small_side(gone, gone.count(), cfg.broadcast_rows), docs[id_col].cast("long") == gone[name], "left_anti")
