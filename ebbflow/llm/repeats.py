"""Operator 8, repeated passages by sparse suffix arrays.

1. Of every text, suffixes are kept at minimisers only: positions whose hash of the next ``anchor`` words is
   the least among ``window`` neighbouring positions. Which positions these are depends on the words
   alone, so a passage of ``anchor + window - 1`` words or more keeps the same ones in every document.
2. Anchors that occur in one document only are dropped by a two-phase aggregate.
3. Kept suffixes carry their context: hashes of the ``right`` words from the anchor on and of the ``left``
   words before it. They are sorted over the cluster by (anchor, right context), which is a sparse
   suffix array, and once more by (anchor, left context), its mirror image. In each order a suffix is
   held against the nearest suffixes of other documents, and the match is extended left and right. So each
   learns the farthest that any other document agrees with it to the right, and to the left.
4. Where the matches found reach that far on both sides, nothing can be missing. A suffix is open where they don't,
   though both reaches together make ``least`` words: its partners on either side may be different documents, and
   a third, parted from it in both orders, may share more. For the anchors of open suffixes the windows
   of ``least`` words that hold the anchor and lie within the reaches are hashed and counted: exact, and without pairs.
5. Matches of ``least`` words or more are merged into maximal passages per document.

Sorting is by range, so a passage that a third of all documents share is spread over many tasks, and
each suffix meets its neighbours only: there are no pairs within a group. Anchors that make up a part of
``1 / hot`` of all suffixes (fewer than ``hot`` of them) are told apart and joined by broadcast. Context words are
compared by 24-bit hashes, so a passage's end may run on by one word once in 17 million ends; anchors use 64 bits.

Edge cases: null and blank texts, and texts shorter than ``least`` words, have no passages; rows with a
null id are left out, as they cannot be named; repeated rows (same id and text) count once, so a
document isn't a repeat of itself, and passages repeated inside one document only are not
reported; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_side, written
from .wordhash import Chunk, chunks


@dataclass(frozen=True)
class RepeatConfig:
    least: int = 50
    anchor: int = 10
    window: int = 40
    left: int = 40  # least - anchor: more is learnt from the next suffix
    right: int = 50
    hot: int = 2000
    anchors_broadcast: int = 500_000  # anchors of 8 bytes
    broadcast_rows: int = 0  # rows of positions may be long: by default texts are joined by shuffle


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width]; the last width - 1 values see what is left."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(c: Chunk, cfg: RepeatConfig) -> tuple[np.ndarray, np.ndarray]:
    """(word positions in the chunk, anchor hashes) of the kept suffixes."""
    at, h = c.grams(cfg.anchor)
    if not len(at):
        return at, h
    doc = c.doc[at]
    last = np.zeros(len(at), bool)  # windows that don't fit into the row
    last[max(0, len(at) - cfg.window + 1) :] = True
    if len(at) >= cfg.window:
        last[: len(at) - cfg.window + 1] = doc[: len(at) - cfg.window + 1] != doc[cfg.window - 1 :]
    low = _slide(h, cfg.window, np.minimum)
    low[last] = 0
    # the greatest window minimum over the windows that hold a position equals its hash iff it is one
    high = _slide(low[::-1], cfg.window, np.maximum)[::-1]
    keep = (high == h) & (h > 0)
    return _thinned(at[keep], h[keep], doc[keep], cfg.window // 2, cfg.window)


def _thinned(at: np.ndarray, h: np.ndarray, doc: np.ndarray, step: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of chains of equal neighbouring minima (repetitive text) one in ``step`` words, and the last.

    Their contexts repeat as well, so any of a chain stands for the others. A member nearer than ``step`` stays
    where the next one is more than ``window`` from the last that stayed, so every window keeps one.
    """
    if not len(at):
        return at, h
    opens = np.ones(len(at), bool)
    opens[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    keep = opens.copy()
    keep[:-1] |= opens[1:]
    keep[-1] = True
    begin = np.nonzero(opens)[0]
    end = np.append(begin[1:], len(at)) - 1
    for i, last in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        while i < last:
            j = min(last, i + 1 + int(np.searchsorted(at[i + 1 : last + 1], at[i] + step)))
            if at[j] - at[i] > window and j - 1 > i:
                j -= 1
            keep[j] = True
            i = j
    return at[keep], h[keep]


def _anchors(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("row_key")
        for c in chunks(batch.column("text")):
            at, h = minimisers(c, cfg)
            row = c.doc[at]
            first = np.searchsorted(c.doc, np.arange(c.rows))
            take = pa.array(c.first + row)
            yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(h.view(np.int64)), pa.array((at - first[row]).astype(np.int32))], ["doc_id", "row_key", "anchor", "pos"])


_WIDTH = 3  # bytes of a context word


def _contexts(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, held = batch.column("doc_id"), batch.column("row_key"), batch.column("held")
        for c in chunks(batch.column("text")):
            word = (c.word >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - _WIDTH :]
            begin = np.searchsorted(c.doc, np.arange(c.rows + 1))
            part = held.slice(c.first, c.rows)
            flat, of = part.flatten(), np.repeat(np.arange(c.rows), np.diff(part.offsets.to_numpy()))
            pos = flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            first, last = begin[of], begin[of + 1]
            ahead, n_ahead = _taken(word, first + pos, last, 1, cfg.right)
            behind, n_behind = _taken(word, first + pos - 1, first, -1, cfg.left)
            take = pa.array(c.first + of)
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), keys.take(take), flat.field("anchor"), pa.array(pos, pa.int32()), _binary(ahead), _binary(behind), pa.array(n_ahead, pa.int32()), pa.array(n_behind, pa.int32())], list(_ROW)
            )


def _taken(word: np.ndarray, start: np.ndarray, stop: np.ndarray, step: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of ``most`` words from each start by step, zero where there are none; how many there are)."""
    n = np.minimum(most, (stop - start) if step > 0 else (start - stop + 1))
    at = start[:, None] + step * np.arange(most)
    there = np.arange(most) < n[:, None]
    out = np.zeros((len(start), most, _WIDTH), np.uint8)
    out[there] = word[at[there]]
    return out.reshape(len(start), most * _WIDTH), n


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_ROW = ("doc_id", "row_key", "anchor", "pos", "ahead", "behind", "n_ahead", "n_behind")
_ROW_SCHEMA = "doc_id long, row_key long, anchor long, pos int, ahead binary, behind binary, n_ahead int, n_behind int"
_FOUND = ("doc_id", "row_key", "anchor", "pos", "first", "last", "other", "reach")
_WALK_SCHEMA = f"kind int, part int, {_ROW_SCHEMA}, first int, last int, other long, reach int"


@dataclass
class _Block:
    """Suffixes as arrays; contexts as one row of bytes each."""

    doc_id: np.ndarray
    row_key: np.ndarray
    anchor: np.ndarray
    pos: np.ndarray
    ahead: np.ndarray
    behind: np.ndarray
    n_ahead: np.ndarray
    n_behind: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, cfg: RepeatConfig, side: str = "") -> _Block:
        out = []
        for k in _ROW:
            col = batch.column(side + k)
            if k in ("ahead", "behind"):
                width = _WIDTH * (cfg.right if k == "ahead" else cfg.left)
                start = col.offset * width
                out.append(np.frombuffer(col.buffers()[2], np.uint8)[start : start + len(col) * width].reshape(len(col), width) if len(col) else np.zeros((0, width), np.uint8))
            else:
                out.append(col.to_numpy(zero_copy_only=False))
        return cls(*out)

    def __len__(self) -> int:
        return len(self.pos)

    def take(self, at) -> _Block:
        return _Block(*(getattr(self, k)[at] for k in _ROW))

    def then(self, other: _Block) -> _Block:
        return _Block(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in _ROW))


def _agree(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leading words that rows of a and b have in common, at most n."""
    differ = (a != b).reshape(len(a), -1, _WIDTH).any(axis=2)
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
    return np.minimum(first, n)


@dataclass
class _Found:
    """Per suffix: the widest passage found, the least partner in it, and the farthest agreement on the sorted side."""

    first: np.ndarray
    last: np.ndarray
    other: np.ndarray
    reach: np.ndarray

    @classmethod
    def none(cls, n: int) -> _Found:
        return cls(np.full(n, _FAR, np.int64), np.full(n, -1, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64))

    def meet(self, at: np.ndarray, a: _Block, b: _Block, cfg: RepeatConfig, forward: bool) -> None:
        """Rows ``at`` are the suffixes a, each held against the suffix of b beside it."""
        if not len(at):
            return
        forth = _agree(a.ahead, b.ahead, np.minimum(a.n_ahead, b.n_ahead))
        back = _agree(a.behind, b.behind, np.minimum(a.n_behind, b.n_behind))
        self.reach[at] = np.maximum(self.reach[at], forth if forward else back)
        hit = forth + back >= cfg.least
        at, pos = at[hit], a.pos[hit].astype(np.int64)
        self.first[at] = np.minimum(self.first[at], pos - back[hit])
        self.last[at] = np.maximum(self.last[at], pos + forth[hit])
        self.other[at] = np.minimum(self.other[at], b.doc_id[hit])


_FAR = 2**31 - 1


def _emit(kind: int, part: int, block: _Block, found: _Found | None, contexts: bool) -> pa.RecordBatch:
    n = len(block)
    none = lambda t: pa.nulls(n, t)
    out = [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, part), pa.int32())]
    out += [pa.array(getattr(block, k), t) for k, t in zip(_ROW[:4], (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
    out += [_binary(block.ahead), _binary(block.behind), pa.array(block.n_ahead, pa.int32()), pa.array(block.n_behind, pa.int32())] if contexts else [none(pa.binary()), none(pa.binary()), none(pa.int32()), none(pa.int32())]
    if found is None:
        out += [none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int32())]
    else:
        miss = found.last < 0
        out += [pa.array(found.first, pa.int32(), mask=miss), pa.array(found.last, pa.int32(), mask=miss), pa.array(found.other, pa.int64(), mask=miss), pa.array(found.reach, pa.int32(), mask=found.reach < 0)]
    return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in _WALK_SCHEMA.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig, forward: bool) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to what each shares with its nearest suffixes of other documents.

    A run is consecutive suffixes of one document and anchor; each of its members meets the last suffix before
    the run and the first after it. Rows of kind 0 are done. The partition's first and last run may have
    neighbours in the partitions beside it: their results are of kind 4, the suffixes themselves of kind 1 (first run)
    and 2 (last run), and of kind 11 the suffix after the first run, of 22 that before the last one.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: _Block | None = None  # the suffix before the open run, if there is one, and that run
    lead, leading = 0, True  # whether held begins with the suffix before the run; whether the run is the partition's first

    def done(block: _Block, lead: int, end: bool) -> tuple[list[pa.RecordBatch], int]:
        """Results of the block's runs but the last one (but none with ``end``), and where that run begins."""
        nonlocal leading
        n = len(block)
        new = np.ones(n, bool)
        new[1:] = (block.doc_id[1:] != block.doc_id[:-1]) | (block.anchor[1:] != block.anchor[:-1])
        starts = np.nonzero(new)[0]
        run = np.cumsum(new) - 1
        before = starts[run] - 1
        after = np.append(starts[1:], n)[run]
        upto = n if end else starts[-1]
        at = np.arange(lead, upto)
        found = _Found.none(n)
        b = at[before[at] >= 0]
        b = b[block.anchor[before[b]] == block.anchor[b]]
        found.meet(b, block.take(b), block.take(before[b]), cfg, forward)
        f = at[after[at] < n]
        f = f[block.anchor[after[f]] == block.anchor[f]]
        found.meet(f, block.take(f), block.take(after[f]), cfg, forward)
        out = []
        first_run = np.zeros(n, bool)
        if leading and len(at):
            stop = starts[1] if len(starts) > 1 else n
            first_run[:stop] = True
            out.append(_emit(1, part, block.take(slice(0, stop)), None, True))
            if stop < n:
                out.append(_emit(11, part, block.take(slice(stop, stop + 1)), None, True))
            leading = False
        last_run = np.zeros(n, bool)
        if end:
            last_run[starts[-1] :] = True
            out.append(_emit(2, part, block.take(slice(starts[-1], n)), None, True))
            if starts[-1] > 0:
                out.append(_emit(22, part, block.take(slice(starts[-1] - 1, starts[-1])), None, True))
        edge = at[(first_run | last_run)[at]]
        inner = at[~(first_run | last_run)[at] & (found.reach[at] >= 0)]
        side = found.last - block.pos if forward else block.pos - found.first
        found.reach[inner] = np.where((found.last[inner] >= 0) & (side[inner] == found.reach[inner]), -1, found.reach[inner])
        for kind, rows in ((0, inner), (4, edge)):
            if len(rows):
                out.append(_emit(kind, part, block.take(rows), _Found(*(x[rows] for x in (found.first, found.last, found.other, found.reach))), False))
        return out, int(starts[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        block = _Block.read(batch, cfg)
        held = block if held is None else held.then(block)
        rows, start = done(held, lead, False)
        yield from rows
        lead = 1 if start else 0
        held = held.take(slice(start - lead, None))
    if held is not None:
        yield from done(held, lead, True)[0]


def _border(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig, forward: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _Block.read(batch, cfg, "a_"), _Block.read(batch, cfg, "b_")
        for x, y, wanted in ((a, b, "a_wants"), (b, a, "b_wants")):
            at = np.nonzero(batch.column(wanted).to_numpy(zero_copy_only=False))[0]
            found = _Found.none(len(at))
            found.meet(np.arange(len(at)), x.take(at), y.take(at), cfg, forward)
            yield _emit(4, 0, x.take(at), found, False)


def _neighbours(suffixes: DataFrame, forward: bool, cfg: RepeatConfig) -> DataFrame:
    """A row per suffix that has neighbours of its anchor in one order: _FOUND. ``reach`` is null where the passage found goes as far."""
    order = ["anchor", "ahead" if forward else "behind", "doc_id", "row_key", "pos"]
    ordered = suffixes.repartitionByRange(*[F.col(k) for k in order]).sortWithinPartitions(*order)
    walked = written(ordered.mapInArrow(lambda it: _walk(it, cfg, forward), _WALK_SCHEMA), "neighbours")
    parts = walked.where("kind IN (1, 2)").select("part").distinct()
    step = parts.select("part", F.lag("part").over(Window.orderBy("part")).alias("from")).where("from IS NOT NULL")  # a row per partition
    named = lambda side: [F.col(k).alias(f"{side}_{k}") for k in _ROW]
    place = F.row_number().over(Window.partitionBy("part", "kind").orderBy(*order))
    runs = walked.where("kind IN (1, 2, 11, 22)").withColumn("k", place).withColumn("of", F.count("*").over(Window.partitionBy("part", "kind")))
    tails = runs.where("kind IN (2, 22)").select(F.col("part").alias("from"), F.col("kind").alias("a_kind"), (F.col("k") == F.col("of")).alias("a_last"), *named("a"))
    heads = runs.where("kind IN (1, 11)").select("part", F.col("kind").alias("b_kind"), (F.col("k") == 1).alias("b_first"), *named("b"))
    met = step.join(tails, "from").join(heads, "part").where("a_anchor = b_anchor AND a_doc_id <> b_doc_id")
    # runs of two documents: the last suffix of one meets all of the other; one document's run over the border: what stands beyond it
    met = met.withColumn("a_wants", F.expr("a_kind = 2 AND (b_kind = 1 AND b_first OR b_kind = 11)")).withColumn("b_wants", F.expr("b_kind = 1 AND (a_kind = 2 AND a_last OR a_kind = 22)"))
    border = met.where("a_wants OR b_wants").mapInArrow(lambda it: _border(it, cfg, forward), _WALK_SCHEMA)
    edges = walked.where("kind = 4").unionByName(border).groupBy(*_FOUND[:4]).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("other").alias("other"), F.max("reach").alias("reach")).where("reach IS NOT NULL")
    side = F.col("last") - F.col("pos") if forward else F.col("pos") - F.col("first")
    edges = edges.withColumn("reach", F.when(~F.coalesce(side == F.col("reach"), F.lit(False)), F.col("reach")))
    return walked.where("kind = 0").select(*_FOUND).unionByName(edges.select(*_FOUND))


def _windows(batches: Iterator[pa.RecordBatch], cfg: RepeatConfig) -> Iterator[pa.RecordBatch]:
    """Digests of the ``least``-word windows that hold the anchor and lie within a suffix's reaches."""
    from hashlib import blake2b

    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, key, is_open, pos, ahead, behind, forth, back in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "row_key", "is_open", "pos", "ahead", "behind", "forth", "back")), strict=True):
            words = [behind[k : k + _WIDTH] for k in range(0, _WIDTH * back, _WIDTH)][::-1]
            text = b"".join(words) + ahead[: _WIDTH * forth]
            for k in range(max(0, back - (cfg.least - cfg.anchor)), min(back, back + forth - cfg.least) + 1):
                digest = blake2b(text[_WIDTH * k : _WIDTH * (k + cfg.least)], digest_size=16).digest()
                for v, o in zip((doc_id, key, is_open, pos - back + k, digest), rows, strict=True):
                    o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["doc_id", "row_key", "is_open", "first", "digest"])


def _open_spans(suffixes: DataFrame, right: DataFrame, left: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """Passages of open suffixes (see the module's text): doc_id, row_key, first, last, other."""
    forth, back = F.coalesce(F.col("reach"), F.col("last") - F.col("pos")), F.coalesce(F.col("reach"), F.col("pos") - F.col("first"))
    none = F.lit(None).cast("int")
    sides = right.select(*_FOUND, forth.alias("forth"), none.alias("back")).unionByName(left.select(*_FOUND, none.alias("forth"), back.alias("back")))
    suspects = right.where("reach IS NOT NULL").unionByName(left.where("reach IS NOT NULL")).select(F.col("anchor").alias("s_anchor")).distinct()
    suspects = checkpointed(suspects)
    near = sides.join(small_side(suspects, suspects.count(), cfg.anchors_broadcast), F.col("anchor") == F.col("s_anchor"), "left_semi")
    reaches = near.groupBy("doc_id", "row_key", "anchor", "pos").agg(F.max("forth").alias("forth"), F.max("back").alias("back"), F.min("first").alias("first"), F.max("last").alias("last")).where(F.col("forth") + F.col("back") >= cfg.least)
    covered = (F.col("first") <= F.col("pos") - F.col("back")) & (F.col("last") >= F.col("pos") + F.col("forth"))
    reaches = written(reaches.select("doc_id", "row_key", "anchor", "pos", "forth", "back", (~F.coalesce(covered, F.lit(False))).alias("is_open")), "reaches")
    anchors = checkpointed(reaches.where("is_open").select(F.col("anchor").alias("s_anchor")).distinct())
    n = anchors.count()
    within = lambda df: df.join(small_side(anchors, n, cfg.anchors_broadcast), F.col("anchor") == F.col("s_anchor"), "left_semi")
    asked = within(reaches).select(F.col("row_key").alias("r_key"), F.col("pos").alias("r_pos"), F.col("anchor").alias("r_anchor"), F.col("doc_id").alias("r_id"), "forth", "back", "is_open")
    same = (F.col("row_key") == F.col("r_key")) & (F.col("pos") == F.col("r_pos")) & (F.col("doc_id") == F.col("r_id")) & (F.col("anchor") == F.col("r_anchor"))
    windows = written(within(suffixes).join(asked, same).mapInArrow(lambda it: _windows(it, cfg), "doc_id long, row_key long, is_open boolean, first int, digest binary"), "windows")
    shared = windows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    hits = windows.where("is_open").join(shared, "digest")
    return hits.select("doc_id", "row_key", "first", (F.col("first") + cfg.least).alias("last"), F.when(F.col("lo") == F.col("doc_id"), F.col("hi")).otherwise(F.col("lo")).alias("other"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc_id, spans in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for s in sorted((x["first"], x["last"], x["other"]) for x in spans):
                if runs and s[0] < runs[-1][1]:
                    runs[-1][1], runs[-1][2] = max(runs[-1][1], s[1]), min(runs[-1][2], s[2])
                else:
                    runs.append(list(s))
            out += [(doc_id, a, b, b - a, o) for a, b, o in runs]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], ["doc_id", "start_word", "end_word", "n_words", "other_doc_id"])


def repeated_passages(docs: DataFrame, cfg: RepeatConfig = RepeatConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per maximal passage that another document has too: doc_id, start_word, end_word (exclusive),
    n_words, other_doc_id (the smallest neighbour's id met in it)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("row_key", F.xxhash64("doc_id", "text"))
    anchors = written(slim.mapInArrow(lambda it: _anchors(it, cfg), "doc_id long, row_key long, anchor long, pos int"), "anchors")
    counted = checkpointed(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n"))
    much = anchors.count() / cfg.hot
    hot = counted.where(F.col("n") > much).select(F.col("anchor").alias("k_anchor"))  # fewer than ``hot`` rows
    rest = counted.where(F.col("n") <= much).select(F.col("anchor").alias("k_anchor"))
    at = F.col("anchor") == F.col("k_anchor")
    known = anchors.join(F.broadcast(hot), at, "left_semi").unionByName(anchors.join(F.broadcast(hot), at, "left_anti").join(rest, at, "left_semi"))
    held = known.groupBy(F.col("doc_id").alias("h_id"), F.col("row_key").alias("h_key")).agg(F.collect_set(F.struct("pos", "anchor")).alias("held"))
    held = written(held, "held")
    once = slim.join(small_side(held, held.count(), cfg.broadcast_rows), (F.col("doc_id") == F.col("h_id")) & (F.col("row_key") == F.col("h_key"))).drop("h_id", "h_key")
    suffixes = written(once.mapInArrow(lambda it: _contexts(it, cfg), _ROW_SCHEMA), "suffixes")
    right, left = written(_neighbours(suffixes, True, cfg), "right"), written(_neighbours(suffixes, False, cfg), "left")
    closed = right.unionByName(left).where("first IS NOT NULL").select("doc_id", "row_key", "first", "last", "other")
    spans = closed.unionByName(_open_spans(suffixes, right, left, cfg)).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "last", "other")).alias("spans"))
    return spans.select("doc_id", "spans").mapInArrow(_merged, "doc_id long, start_word long, end_word long, n_words long, other_doc_id long")
