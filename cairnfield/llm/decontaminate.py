"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are parted by the size of their shingle sets. For each part, documents are read in blocks of words about as
long as its items, so that an item inside a long document still has a large Jaccard similarity with the blocks that
hold it, and their minima agree under some of many hash functions. Agreeing pairs are verified by exact containment of
the item's shingles in the whole document. Nothing is shuffled; items come in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.words import SHINGLE, chunks, find_words, shingle_hashes
from cairnfield.llm.work import refuse_clashes

THRESHOLD_PERCENT = 80
HASHES = 64
ITEM_BLOCK = 20_000  # items that are searched at once

_ODD = np.random.default_rng(7).integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = np.random.default_rng(8).integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each hash function over consecutive blocks of ``width`` values: one row per function."""
    low = (hashes >> np.uint64(16)).astype(np.uint32)
    heads = np.arange(0, len(low), width)
    return np.stack([np.minimum.reduceat((low ^ f) * a, heads) for a, f in zip(_ODD, _FLIP, strict=True)])


@dataclass
class Part:
    """Items of one size class: for each hash function their minima in order, and which items have them."""

    width: int
    values: list[np.ndarray]
    items: list[np.ndarray]
    seen: np.ndarray  # for each function, which low bits occur at all
    mask: int


@dataclass
class Index:
    parts: list[Part]
    ids: list
    sets: list[frozenset[str]]


def _shingle_strings(text: str) -> set[str]:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if not text.isascii() else text.lower()
    words = words.translate(_TO_SPACE).split(" ")
    words = [w for w in words if w]
    if 0 < len(words) < SHINGLE:
        return {" ".join(words)}
    return {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


_TO_SPACE = {c: " " for c in (9, 10, 11, 12, 13)}


def build_index(ids: list, texts: list[str]) -> Index:
    """Index of the items that have any words."""
    sets = [frozenset(_shingle_strings(t)) for t in texts]
    kept = [i for i, s in enumerate(sets) if s]
    ids, sets, texts = [ids[i] for i in kept], [sets[i] for i in kept], [texts[i] for i in kept]
    doc, hashes = shingle_hashes(find_words(pa.array(texts, pa.string())))
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    classes: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)  # widths 1, 2, 4, ...: the next power of two
    parts = []
    for width, members in sorted(classes.items()):
        minima = np.column_stack([_minima(hashes[cuts[i] : cuts[i + 1]], int(cuts[i + 1] - cuts[i])) for i in members])
        bits = max(12, min(22, (64 * len(members)).bit_length()))
        mask = (1 << bits) - 1
        seen = np.zeros((HASHES, mask + 1), bool)
        order = np.argsort(minima, axis=1, kind="stable")
        for k in range(HASHES):
            seen[k, minima[k] & mask] = True
        parts.append(Part(width, [minima[k][order[k]] for k in range(HASHES)], [np.array(members)[order[k]] for k in range(HASHES)], seen, mask))
    return Index(parts, ids, sets)


def candidates(index: Index, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct (text number, item number) pairs that agree in a minimum of some block."""
    if not len(hashes) or not index.parts:
        return np.zeros((0, 2), np.int64)
    # Blocks begin anew with each text: every text is padded to whole blocks of the widest class.
    widest = index.parts[-1].width
    counts = np.bincount(doc)
    rooms = -(-counts // widest) * widest
    shift = (np.cumsum(rooms) - rooms) - (np.cumsum(counts) - counts)
    place = np.arange(len(doc)) + shift[doc]
    low = (hashes >> np.uint64(16)).astype(np.uint32)
    owner = np.repeat(np.arange(len(counts)), rooms)
    narrow = index.parts[0].width
    grid = np.zeros(int(rooms.sum()), np.uint32)
    grid[place] = low
    empty = np.ones(len(grid), bool)
    empty[place] = False
    gaps = np.flatnonzero(empty)
    pairs = []
    for k, (a, f) in enumerate(zip(_ODD, _FLIP, strict=True)):
        value = (grid ^ f) * a
        value[gaps] = 0xFFFFFFFF
        level, minima = narrow, value.reshape(-1, narrow).min(axis=1) if narrow > 1 else value
        for part in index.parts:
            if part.width > level:
                minima = minima.reshape(-1, part.width // level).min(axis=1)
                level = part.width
            hit = np.flatnonzero(part.seen[k][minima & part.mask])
            if not len(hit):
                continue
            left = np.searchsorted(part.values[k], minima[hit], side="left")
            right = np.searchsorted(part.values[k], minima[hit], side="right")
            n = right - left
            which = np.repeat(left, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.column_stack([np.repeat(owner[hit * level], n), part.items[k][which]]))
    found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return np.unique(found, axis=0)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    percent: int = THRESHOLD_PERCENT,
    block: int = ITEM_BLOCK,
) -> DataFrame:
    """Pairs (document key, item key, n_item, n_shared) with 100 * n_shared >= percent * n_item.

    n_item is the number of distinct five-word shingles of the item (its whole word sequence, if shorter), n_shared how
    many of them the document has anywhere. Items and documents that are null or without words match nothing; repeated
    rows match each by itself, ties included. Only keys and texts are read. A pair is missed only if none of 64 minima
    agrees in any block: for a contained passage that has a probability below one in a million.

    Items are fetched in blocks of ``block`` rows by a hash of their key, one search per block. Columns of one name are
    an error, so keys that share theirs must be renamed before.
    """
    refuse_clashes(doc_key, item_key, "n_item", "n_shared")
    spark = docs.sparkSession
    rows = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    blocks = -(-rows.count() // block)
    doc_kind, item_kind = docs.schema[doc_key].dataType, items.schema[item_key].dataType
    schema = T.StructType(
        [T.StructField("d", doc_kind), T.StructField("i", item_kind), T.StructField("n_item", T.LongType()), T.StructField("n_shared", T.LongType())]
    )
    source = docs.select(F.col(doc_key).alias("d"), F.col(doc_text).alias("t"))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).toArrow()
        index = build_index(mine.column("k").to_pylist(), mine.column("t").to_pylist())
        shared = spark.sparkContext.broadcast((index, pa.array(index.ids, mine.schema.field("k").type)))
        found = source.mapInArrow(_search(shared, percent), schema)
        out = found if b == 0 else out.unionByName(found)
    return out.select(F.col("d").alias(doc_key), F.col("i").alias(item_key), "n_item", "n_shared")


def _search(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shared.value
        for whole in batches:
            for batch in chunks(whole, "t"):
                pairs = candidates(index, *shingle_hashes(find_words(batch.column("t"))))
                texts, rows, last, mine = batch.column("t"), [], -1, set()
                for d, i in pairs.tolist():
                    if d != last:
                        last, mine = d, _shingle_strings(texts[d].as_py())
                    n_item, n_shared = len(index.sets[i]), len(index.sets[i] & mine)
                    if 100 * n_shared >= percent * n_item:
                        rows.append((d, i, n_item, n_shared))
                d, i, n_item, n_shared = (pa.array([r[c] for r in rows], pa.int64()) for c in range(4))
                yield pa.RecordBatch.from_arrays([batch.column("d").take(d), ids.take(i), n_item, n_shared], names=["d", "i", "n_item", "n_shared"])

    return run
