"""Vectorised word kernels over Arrow string columns (runs inside Python workers).

A batch is cut into chunks of bounded bytes; a longer text is a chunk of its own. In a chunk every word gets a
64-bit polynomial hash read off prefix sums, so no Python object is made per word; shingles, n-grams and
lines are hashed from those. Prefix sums span ``CHUNK_BYTES`` (or the longest word or line) at a time, so a
very long text costs flags of a byte and numbers per word, not numbers per byte. Texts are UTF-8, and the white space of the word rule is ASCII, so byte
positions decide word borders exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
SLICE_ROWS = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, CHUNK_BYTES + 1)
        fill = np.full(n, _BASE)
        fill[0] = 1
        _powers = np.cumprod(fill, dtype=np.uint64)
        fill = np.full(n, _INVERSE)
        fill[0] = 1
        _inverses = np.cumprod(fill, dtype=np.uint64)
    return _powers, _inverses


@dataclass
class Chunk:
    """Some consecutive rows of a batch. ``doc``: row of each word, counted from ``first``."""

    first: int
    data: np.ndarray  # bytes, lower-cased if asked
    offsets: np.ndarray  # rows + 1 byte positions
    space: np.ndarray
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    doc: np.ndarray
    word: np.ndarray  # 64-bit hash of each word

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def n_words(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each run of n words of one row."""
        if len(self.word) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.nonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])[0]
        h = np.full(len(self.word) - n + 1, np.uint64(n))
        for k in range(n):
            h = h * _STEP + self.word[k : len(self.word) - n + 1 + k]
        return at, mix64(h[at])


def chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, separators: np.ndarray | None = None) -> Iterator[Chunk]:
    """Chunks of a string column; null is the empty text. separators: 256 flags, instead of white space."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for first in range(0, len(texts), SLICE_ROWS):
        part = pc.fill_null(texts.slice(first, SLICE_ROWS).cast(pa.large_string()), "")
        _, off, dat = part.buffers()
        offsets = np.frombuffer(off, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(dat, np.uint8) if dat is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(part):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            yield _chunk(first + at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, _SPACE if separators is None else separators)
            at = to


def _chunk(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool, table: np.ndarray) -> Chunk:
    if lower:
        data = _LOWER[data]
    n = len(data)
    space = table[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    start = np.nonzero(~space & (before | begins[:-1]))[0]
    after = before
    after[-1:] = True
    after[:-1] = space[1:]
    end = np.nonzero(~space & (after | begins[1:]))[0] + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Chunk(first, data, offsets, space, start, end, doc, range_hash(data, start, end))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), which are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        to = max(k + 1, int(np.searchsorted(end, start[k] + CHUNK_BYTES, "right")))
        a, b = int(start[k]), int(end[to - 1])
        power, inverse = _tables(b - a + 1)
        prefix = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=prefix[1:])
        s, e = start[k:to] - a, end[k:to] - a
        out[k:to] = mix64((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(np.uint64) * _STEP)
        k = to
    return out


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags over each [offsets[i], offsets[i + 1])."""
    out = np.zeros(len(offsets) - 1, np.int64)
    filled = offsets[1:] > offsets[:-1]
    if filled.any():  # the ranges that aren't empty adjoin each other
        out[filled] = np.add.reduceat(flags, offsets[:-1][filled], dtype=np.int64)
    return out


def shingle_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows + 1 offsets, hashes): the distinct n-word shingles of each row, sorted within it.

    A row with fewer than n words, but any, has its whole sequence as its one shingle.
    """
    at, h = chunk.grams(n)
    doc = chunk.doc[at]
    counts = chunk.n_words()
    for size in range(1, n):
        short = np.nonzero(counts == size)[0]
        if len(short):
            at, g = chunk.grams(size)
            keep = counts[chunk.doc[at]] == size
            doc, h = np.concatenate([doc, chunk.doc[at[keep]]]), np.concatenate([h, g[keep]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(chunk.rows + 1)), h
