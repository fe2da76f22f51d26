"""Operator 5, mixture-controlled packing by deficit round-robin over source queues.

Texts are tokenised once, in place, and their ids (two bytes each while the vocabulary allows) written
to the shared folder. Documents are dealt by hash to buckets of about ``bucket_tokens`` tokens, so each
bucket holds every source in about its share, and one hot source or long text cannot fill a bucket alone.

A bucket is packed by one task, window by window. In a window every source earns its target share of
``window_tokens`` on top of its deficit, and is served that many tokens from its queue (documents in
hash order, cut where the share ends); what rounding or an empty queue leaves unserved stays in the
deficit for the next window. Deficits also cross buckets: as each bucket packs all its tokens, what a
source is owed when bucket b starts is ``target * tokens before b - its own tokens before b``, a prefix sum
over the small (bucket, source) table in two levels (within blocks of buckets, and over blocks), so buckets need
not wait for one another and no task walks all of them. A task has a bucket or a few. The default targets are
the sources' shares of all tokens; given targets steer the order, and tokens left when other queues
are empty are packed with whatever remains, since every id has to lie in exactly one piece.

The bucket's stream is cut into sequences of ``length`` tokens; the rest, shorter than that, is cut by its
binary digits into sequences of power-of-two lengths, which need no padding.

Edge cases: null text is the empty text, whose only id is the end id; a null source is a source of
its own; null ids are packed under null; repeated rows are packed each; an empty table gives an empty
result; extra columns are not read. Ids equal those of the JSON tokenizer: texts made only of
characters on which both libraries split alike go through the faster one with the same vocabulary,
all others (and those holding a special token's string) through the JSON tokenizer itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written

#: ASCII and Latin letters and common punctuation: both libraries' patterns split these alike.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-Ɂ‐-―‘-‟†-•…€]*")


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str = "byte_bpe_50k.json"
    ranks: str | None = "byte_bpe_50k.tiktoken"  # the same vocabulary; None: the JSON tokenizer for all texts
    end_id: int = 0
    length: int = 1024
    window_tokens: int = 64 * 1024
    bucket_tokens: int = 2_000_000
    targets: dict[str, float] = field(default_factory=dict)  # empty: shares of all tokens
    block: int = 2048  # buckets of a block of the prefix sums
    most_tasks: int = 100_000


def encoder(cfg: PackConfig):
    """A function from a list of texts to their id arrays, without the end id."""
    import base64
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(public_tokenizers.path(cfg.tokenizer))
    if cfg.ranks is None:
        return lambda texts: [np.array(e.ids, np.uint32) for e in slow.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    with open(public_tokenizers.path(cfg.ranks), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if _PLAIN.fullmatch(text) and not any(s in text for s in special):
                out.append(np.array(fast.encode_ordinary(text), np.uint32))
            else:
                out.append(np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32))
        return out

    return encode


def _tokenise(batches: Iterator[pa.RecordBatch], cfg: PackConfig) -> Iterator[pa.RecordBatch]:
    encode = encoder(cfg)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            ids = [np.append(x, np.uint32(cfg.end_id)) for x in encode([t or "" for t in part.column("text").to_pylist()])]
            wide = [bool(len(x) and x.max() > 0xFFFF) for x in ids]
            packed = [x.astype(np.uint32 if w else np.uint16).tobytes() for x, w in zip(ids, wide, strict=True)]
            crc = [zlib.crc32(p) for p in packed]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(wide), pa.array(packed, pa.binary())], ["doc_id", "source", "n_tokens", "crc", "wide", "ids"])


def tokenised(docs: DataFrame, cfg: PackConfig = PackConfig(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda it: _tokenise(it, cfg), "doc_id long, source string, n_tokens long, crc long, wide boolean, ids binary")


def deal(avail: dict[str, int], share: dict[str, float], deficit: dict[str, float], room: int) -> dict[str, int]:
    """Tokens to serve each source in a window of ``room`` tokens; ``deficit`` is carried in place.

    Shares are renewed over the sources that still have tokens; all of ``room`` is dealt while any has.
    """
    live = [s for s in avail if avail[s] > 0]
    whole = sum(share[s] for s in live)
    for s in live:
        deficit[s] += room * (share[s] / whole if whole > 0 else 1.0 / len(live))
    served = dict.fromkeys(live, 0)
    left = min(room, sum(avail[s] for s in live))
    for s in sorted(live, key=lambda s: (-deficit[s], s)):
        served[s] = min(avail[s], max(0, int(deficit[s])), left)
        left -= served[s]
    while left:  # what rounding, debts or empty queues left over: in proportion again, then one by one
        more = sorted((s for s in live if served[s] < avail[s]), key=lambda s: (served[s] - deficit[s], s))
        whole, room = sum(share[s] for s in more), left
        for s in more:
            part = int(room * (share[s] / whole if whole > 0 else 1.0 / len(more)))
            step = min(part if part else 1, avail[s] - served[s], left)
            served[s] += step
            left -= step
    for s in live:
        deficit[s] -= served[s]
    return served


def cut_points(total: int, length: int) -> np.ndarray:
    """Ends of the sequences of a stream of ``total`` tokens: full ones, then powers of two."""
    ends = list(range(length, total + 1, length))
    at, rest = total - total % length, total % length
    while rest:
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
        ends.append(at)
    return np.array(ends, np.int64)


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack_bucket(rows: pa.Table, owed: pa.Table, cfg: PackConfig, with_ids: bool = False) -> pa.Table:
    rows = rows.sort_by([("draw", "ascending"), ("doc_id", "ascending"), ("crc", "ascending")])
    bucket = rows.column("bucket")[0].as_py() if rows.num_rows else 0
    sources, sizes, doc_ids = rows.column("source").to_pylist(), rows.column("n_tokens").to_pylist(), rows.column("doc_id").to_pylist()
    state = {s: (share, deficit) for s, share, deficit in zip(*(owed.column(k).to_pylist() for k in ("source", "share", "deficit")), strict=True)}
    queues: dict[str, list[int]] = {}
    for k, s in enumerate(sources):
        queues.setdefault(s, []).append(k)
    avail = {s: sum(sizes[k] for k in q) for s, q in queues.items()}
    share, deficit = {s: state[s][0] for s in queues}, {s: state[s][1] for s in queues}
    head, done = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
    pieces: list[tuple[int, int, int]] = []
    while any(avail.values()):
        for s, n in deal(avail, share, deficit, cfg.window_tokens).items():
            avail[s] -= n
            while n:
                k = queues[s][head[s]]
                take = min(n, sizes[k] - done[s])
                pieces.append((k, done[s], take))
                n -= take
                done[s] += take
                if done[s] == sizes[k]:
                    head[s], done[s] = head[s] + 1, 0
    of, start, size = (np.array(x, np.int64) for x in zip(*pieces, strict=True)) if pieces else (np.zeros(0, np.int64),) * 3
    end = np.cumsum(size)
    cuts = cut_points(int(end[-1]) if len(end) else 0, cfg.length)
    borders = np.union1d(end, cuts)
    begins = np.concatenate([[0], borders[:-1]]).astype(np.int64) if len(borders) else borders.astype(np.int64)
    piece = np.searchsorted(end, begins, "right")
    seq = np.searchsorted(cuts, begins, "right")
    seq_start = np.concatenate([[0], cuts])[seq]
    at = start[piece] + begins - (end - size)[piece]
    length, doc = borders - begins, of[piece]
    raw, wide = rows.column("ids").to_pylist(), rows.column("wide").to_pylist()
    held, ids, crcs, texts = -1, None, [], []
    for k, a, n in zip(doc.tolist(), at.tolist(), length.tolist(), strict=True):
        if k != held:
            held, ids = k, np.frombuffer(raw[k], np.uint32 if wide[k] else np.uint16).astype("<u4")
        b = ids[a : a + n].tobytes()
        crcs.append(zlib.crc32(b))
        if with_ids:
            texts.append(b)
    out = {
        "doc_id": pa.array([doc_ids[k] for k in doc.tolist()], pa.int64()), "start": pa.array(at, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
        "doc_tokens": pa.array([sizes[k] for k in doc.tolist()], pa.int64()), "sequence_id": pa.array((bucket << 32) + seq, pa.int64()), "offset": pa.array(begins - seq_start, pa.int64()), "source": pa.array([sources[k] for k in doc.tolist()], pa.string()),
    }
    if with_ids:
        out["ids"] = pa.array(texts, pa.binary())
    return pa.table(out)


def _before(cells: DataFrame, keys: list[str], cfg: PackConfig) -> DataFrame:
    """``cells`` with ``before``: the sum of n over earlier buckets of the same keys."""
    block = F.floor(F.col("bucket") / cfg.block).alias("block")
    inside = Window.partitionBy(*keys, "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per ``block`` buckets
    blocks = cells.groupBy(*keys, block).agg(F.sum("n").alias("n")).select(*keys, "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("earlier"))
    rows = cells.select("*", block).withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.join(blocks, [*keys, "block"]).withColumn("before", F.col("earlier") + F.col("within")).drop("block", "within", "earlier")


def pack(docs: DataFrame, cfg: PackConfig = PackConfig(), with_ids: bool = False, **columns: str) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    with_ids adds the piece's ids, little-endian unsigned 32-bit.
    """
    tokens = written(tokenised(docs, cfg, **columns), "tokens", "zstd")
    sums = checkpointed(tokens.groupBy("source").agg(F.sum("n_tokens").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-total // cfg.bucket_tokens))
    draw = F.xxhash64("doc_id", "crc", F.lit(7))
    dealt = tokens.select("*", draw.alias("draw"), F.pmod(draw, F.lit(n_buckets)).alias("bucket"))
    if cfg.targets:
        wanted = F.create_map(*[F.lit(x) for kv in cfg.targets.items() for x in kv])
        share = F.coalesce(wanted[F.col("source")].cast("double"), F.lit(0.0)) / float(sum(cfg.targets.values()))
    else:
        share = F.col("n") / F.lit(float(max(1, total)))
    shares = sums.select("source", share.alias("share"))
    # what each source is owed as a bucket starts: prefix sums over (bucket, source)
    cells = checkpointed(dealt.groupBy("bucket", "source").agg(F.sum("n_tokens").alias("n")))
    by_bucket = cells.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = _before(by_bucket, [], cfg).select("bucket", F.col("before").alias("t_before"))
    owed = _before(cells, ["source"], cfg).select("bucket", "source", F.col("before").alias("own")).join(before, "bucket").join(shares, "source")
    owed = owed.select("bucket", "source", "share", (F.col("share") * F.col("t_before") - F.col("own")).alias("deficit"))
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    return dealt.repartition(min(cfg.most_tasks, n_buckets), "bucket").groupBy("bucket").cogroup(checkpointed(owed).groupBy("bucket")).applyInArrow(lambda a, b: pack_bucket(a, b, cfg, with_ids), schema)
