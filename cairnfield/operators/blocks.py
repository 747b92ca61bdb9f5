"""Ranked search that reads only the postings that can still matter.

Postings of a term are kept in blocks of like weight. Each block row carries its largest weight beside its entries. A
first pass over the heaviest blocks of the asked terms gives a score that the last result has at least; a block whose
weight, with the largest of all other terms, stays below it holds no result and isn't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators.textsearch import IDF_FLOOR, K1, B, TextIndex, _words
from cairnfield.session import cut_lineage

BLOCK_ENTRIES = 128
LEVELS = 64  # of weight, between 0 and the largest there can be
SLACK = 1e-9


@dataclass(frozen=True)
class BlockIndex:
    """``blocks`` (term, best, n, entries of key and weight) and the ``texts`` indexed."""

    blocks: DataFrame
    texts: int
    key: str


def _weight(average: float) -> Column:
    """What a term adds to a text's score, without the term's rarity: less than K1 + 1."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average)))


def build_blocks(index: TextIndex, block_entries: int = BLOCK_ENTRIES) -> BlockIndex:
    """Blocks of ``block_entries`` entries at most, of one level of weight each.

    Entries are dealt by ranges of a hash of term and level, then key, sorted by that hash and cut as they pass. No term
    is gathered as a whole; where two hashes are equal blocks are shorter.
    """
    lengths = cut_lineage(index.lengths)
    texts, average = lengths.agg(F.count(F.lit(1)), F.avg("length")).first()
    # Once dealt by key for the join, the fields of a text are summed in place; lengths are the small side.
    whole = index.postings.select("term", index.key, "tf").join(lengths.hint("shuffle_hash"), index.key)
    if not index.one_field:
        whole = whole.groupBy("term", index.key, "length").agg(F.sum("tf").alias("tf"))
    level = F.floor(F.col("weight") * (LEVELS / (K1 + 1))).cast("int")
    rows = whole.withColumn("weight", _weight(average or 1.0)).select("term", level.alias("level"), F.col(index.key).alias("key"), "weight")
    # Ranges are drawn from a sample, which would make every row twice. One number is sorted faster than words.
    spots = cut_lineage(rows).withColumn("spot", F.xxhash64("term", "level"))
    dealt = spots.repartitionByRange("spot", "key").sortWithinPartitions("spot").drop("spot")
    kind = rows.schema["key"].dataType.simpleString()
    blocks = dealt.mapInArrow(_cut(block_entries), f"term string, best double, n bigint, entries array<struct<key: {kind}, weight: double>>")
    return BlockIndex(blocks, texts, index.key)


def _cut(block_entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows of ``term, level, key, weight`` cut where term or level change, and after ``block_entries`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            terms, levels = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            same = pc.equal(terms.slice(1), terms.slice(0, n - 1)).to_numpy(zero_copy_only=False) & (levels[1:] == levels[:-1])
            first = np.flatnonzero(np.append(True, ~same))
            since = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            starts = np.flatnonzero(since % block_entries == 0)
            weights = batch.column(3)
            best = np.maximum.reduceat(weights.to_numpy(zero_copy_only=False), starts)
            ends = np.append(starts, n).astype(np.int32)
            entries = pa.StructArray.from_arrays([batch.column(2), weights], ["key", "weight"])
            columns = [terms.take(pa.array(starts)), pa.array(best), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), entries)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "best", "n", "entries"])

    return run


def write_blocks(index: BlockIndex, path: str, files: int = 64) -> None:
    """Stored by term, heaviest first, so that statistics of row groups skip what a search doesn't need."""
    order = ["term", F.desc("best")]
    index.blocks.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_blocks(spark: SparkSession, path: str, texts: int, key: str) -> BlockIndex:
    return BlockIndex(spark.read.parquet(path), texts, key)


def _statistics(index: BlockIndex, words: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Rarity and largest weight of each asked term that occurs: one row per term of the question."""
    sums = index.blocks.filter(F.col("term").isin(*words)).groupBy("term").agg(F.sum("n").alias("df"), F.max("best").alias("best"))
    idf = F.greatest(F.log((F.lit(index.texts) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    return {r.term: (r.idf, r.best) for r in sums.select("term", idf.alias("idf"), "best").collect()}


def _scores(blocks: DataFrame, known: dict[str, tuple[float, float]], every: bool) -> DataFrame:
    idf = F.create_map(*[F.lit(x) for term, (value, _) in known.items() for x in (term, value)])
    entries = blocks.select(idf[F.col("term")].alias("idf"), F.explode("entries").alias("e"))
    sums = entries.groupBy(F.col("e.key").alias("key")).agg(F.sum(F.col("idf") * F.col("e.weight")).alias("score"), F.count(F.lit(1)).alias("terms"))
    return sums.filter(F.col("terms") == len(known)) if every else sums


def needed_blocks(index: BlockIndex, words: Sequence[str], limit: int, every: bool = False) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """The blocks that can hold one of the best ``limit`` texts, and the statistics of the asked terms."""
    known = _statistics(index, words)
    if not known or every and len(known) < len(set(words)):
        return index.blocks.filter(F.lit(False)), known
    first = None
    for term in known:
        top = index.blocks.filter(F.col("term") == term).orderBy(F.desc("best")).limit(limit)  # each has an entry
        first = top if first is None else first.unionByName(top)
    reached = _scores(first, known, every).orderBy(F.desc("score")).limit(limit).agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).first()
    least = reached.s if reached.n == limit else 0.0
    total = sum(idf * best for idf, best in known.values())
    keep = F.lit(False)
    for term, (idf, best) in known.items():
        others = total - idf * best
        keep = keep | (F.col("term") == term) & (F.col("best") >= F.lit(float((least - others) / idf - SLACK)))
    return index.blocks.filter(keep), known


def search_blocks(index: BlockIndex, limit: int = 10, all: Sequence[str] = (), any: Sequence[str] = ()) -> DataFrame:
    """The best ``limit`` keys with ``rank``, as `textsearch.search_text` gives them for words that must or may occur."""
    if bool(all) == bool(any):
        raise ValueError("give either all or any words")
    words = sorted({w for ws in _words(index.blocks.sparkSession, list(all or any)) for w in ws})
    blocks, known = needed_blocks(index, words, limit, bool(all)) if words else (index.blocks.filter(F.lit(False)), {})
    if not known:
        return blocks.select(F.explode("entries").alias("e")).select(F.col("e.key").alias(index.key), F.col("e.weight").alias("rank"))
    found = _scores(blocks, known, bool(all)).select(F.col("key").alias(index.key), (-F.col("score")).alias("rank"))
    return found.orderBy("rank", index.key).limit(limit)
