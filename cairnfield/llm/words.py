"""Words and word shingles of whole Arrow columns at once, as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lowered where asked. Words and shingles are known by
64-bit hashes: a polynomial over random byte values, so that every word hash comes from two entries of one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE = 5

_FACTOR = 0x9E3779B97F4A7C15 - 0x10  # 5 mod 8
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each; a longer text is a slice of its own."""
    ends = text_buffer(batch.column(column))[1][1:].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (one more than texts); null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _FACTOR, np.uint64)
    down = np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``; equal bytes give equal hashes wherever they stand."""
    size = 1 << max(16, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of the texts
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # text number of each word
    first: np.ndarray  # number of the first word of each text, and the count of all words at the end
    hashes: np.ndarray


def find_words(texts: pa.Array, lower: bool = True) -> Words:
    raw, offsets = text_buffer(texts)
    data = LOWER[raw] if lower else raw
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    begin, last = offsets[:-1][filled], offsets[1:][filled] - 1
    start[begin] = inside[begin]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, starts, ends, doc, first, span_hashes(data, starts, ends))


def shingle_hashes(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``size`` words; a text with fewer words has its whole sequence as one."""
    n = len(words.hashes)
    counts = np.diff(words.first)
    total = np.zeros(n, np.uint64)
    length = np.minimum(counts, size)[words.doc]
    left = words.first[1:][words.doc] - np.arange(n)  # words from here to the end of the text
    for j in range(size):
        here = np.zeros(n, np.uint64)
        here[: max(n - j, 0)] = words.hashes[j:]
        here[(j >= length) | (j >= left)] = 0
        total = total * np.uint64(_FACTOR) + here
    keep = (left >= length) & ((counts[words.doc] >= size) | (left == length))
    return words.doc[keep], mix(total + length[keep].astype(np.uint64) if keep.all() else total[keep] + length[keep].astype(np.uint64))


def distinct_per_text(doc: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one after the other, and their offsets."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[keep], hashes[keep]
    return hashes, np.searchsorted(doc, np.arange(texts + 1))


def id_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


class KeyCache:
    """Rows of numbers by 64-bit key, kept by a worker between batches; at most ``limit`` keys, the first that come."""

    def __init__(self, width: int, kind=np.float64, limit: int = 600_000):
        self.limit = limit
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, width), kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each key among the rows, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, rows: np.ndarray) -> bool:
        """Keep new keys if there is room for them; whether there was."""
        if len(self.keys) + len(keys) > self.limit:
            return False
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], np.concatenate([self.rows, rows])[order]
        return True
