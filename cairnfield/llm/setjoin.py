"""Jaccard join of word-shingle sets that skips by relations between sets.

Shingles are ordered by falling rarity, as counters over all texts tell it, so that two sets with the asked similarity
share a shingle in their prefixes. Index lists hold the prefix shingles of all distinct sets with size and position. Long
lists are cut into blocks of like sizes and positions; pairs of blocks whose bounds rule out every pair of members are
skipped before members meet. Answers are then derived from those of similar sets:

1. Each list entry is compared with the entry before it and the first of its list only. Equal sets count as one.
2. In rounds, entries of longer lists that aren't linked yet are compared with a few chosen ones of their size: those
   that have been nearest to others so far, and some by chance. A large group of near copies becomes one component in work that grows with its size.
3. Sets that are linked by now need no comparison. For the others, the distance between the sets they are anchored to,
   less their own distances from these, bounds their distance (Jaccard distance is a metric); only pairs that this
   leaves open are compared. The result is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.components import components
from cairnfield.llm.words import SHINGLE, chunks, distinct_per_text, find_words, id_lists, mix, shingle_hashes
from cairnfield.llm.work import Step, collect_garbage, refuse_clashes

PERCENT = 80
FREQUENT_SHARE = 0.002  # of all texts, from which a shingle's list is parted by salts
FREQUENT_TEXTS = 10_000  # or this number, if it is less
BUCKETS = 1 << 22  # counters of shingles by hash
COUNTER_BLOCK = 1 << 14  # counters that are sent and added up together
PENDING = 1 << 21  # hashes that wait to be counted
PARTNERS = 2
ROUND_PARTNERS = 4  # that a set is compared with in a round
ROUNDS = 12  # at most; they end when fewer than one comparison in ``LEAST_LINKS`` links
LEAST_LINKS = 50
CENTRAL = 8
PRIOR = 0.3  # a distance that every set counts as one comparison
SHORT_LIST = 8  # entries up to which a list is left out of the rounds; it has few pairs
BROADCAST_KEYS = 1_000_000
FOREST_NODES = 500_000  # that a task holds at a time
FOREST_LINKS = 250_000  # of the first comparisons, that make a task
CELL_TEXTS = 256
SALTS = 16  # parts of the index list of a frequent shingle
LONG_LIST = 64  # entries from which a list is cut into blocks
PART_ENTRIES = 16_384  # of a list, to which a part of its blocks comes


def _count(size: int):
    """Per task: counters of the shingles of its texts, in packed blocks, and the number of texts in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(BUCKETS, np.uint32), 0
        pending: list[np.ndarray] = []

        def settle() -> None:
            if pending:
                counts[:] += np.bincount(np.concatenate(pending), minlength=BUCKETS).astype(np.uint32)
                pending.clear()

        for whole in batches:
            for batch in chunks(whole, "t"):
                doc, hashes = shingle_hashes(find_words(batch.column("t")), size)
                hashes = distinct_per_text(doc, hashes >> np.uint64(1), batch.num_rows)[0]
                pending.append((hashes & np.uint64(BUCKETS - 1)).astype(np.int32))
                texts += batch.num_rows
                if sum(map(len, pending)) >= PENDING:
                    settle()
        settle()
        for i, block in enumerate(counts.reshape(-1, COUNTER_BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([texts]), pa.array([zlib.compress(block.tobytes(), 1)])], names=["block", "texts", "data"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counters of each block; a task holds the sums of its blocks only."""
    sums: dict[int, np.ndarray] = {}
    texts: dict[int, int] = {}
    for batch in batches:
        for i, n, data in zip(*(batch.column(c).to_pylist() for c in ("block", "texts", "data")), strict=True):
            sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)
            texts[i] = texts.get(i, 0) + n
    for i, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([i]), pa.array([texts[i]]), pa.array([int(total.sum())]), pa.array([_level(total).tobytes()])], names=["block", "texts", "n", "levels"]
        )


def _level(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of four steps an octave."""
    return (4 * np.log2(1.0 + count)).astype(np.uint8)


def shingle_levels(texts: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, int]:
    """How often shingles stand in column ``t``: a level for each counter, 4 MB, and the level from which one is frequent.

    A counter is shared by the shingles with equal last bits of their hashes. Levels decide an order and how lists are
    parted, never whether something is compared.
    """
    found = texts.select("t").mapInArrow(_count(size), "block long, texts long, data binary").repartition("block")
    levels, n, total = np.zeros(BUCKETS, np.uint8), 0, 0
    for block, texts_, sum_, data in found.mapInArrow(_add_up, "block long, texts long, n long, levels binary").collect():  # BUCKETS bytes
        levels[block * COUNTER_BLOCK : (block + 1) * COUNTER_BLOCK] = np.frombuffer(data, np.uint8)
        n, total = max(n, texts_), total + sum_
    mean = total / BUCKETS
    least = max(8, min(FREQUENT_SHARE * n, FREQUENT_TEXTS), mean + 8 * mean**0.5)
    return levels, int(_level(np.array([least]))[0]) + 1


def _codes(texts: pa.Array, levels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """63-bit hashes of each text's distinct shingles by level, then hash; their levels; offsets of texts."""
    doc, hashes = shingle_hashes(find_words(texts), size)
    hashes, cuts = distinct_per_text(doc, hashes >> np.uint64(1), len(texts))
    level = levels[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    order = np.argsort(np.repeat(np.arange(len(texts)) << 8, np.diff(cuts)) | level, kind="stable")
    return hashes[order], level[order], cuts


def _needed(n, percent: int):
    """Smallest overlap of a set of ``n`` with a similar one."""
    return (percent * n + 99) // 100


def shingle_prefixes(texts: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """Per row of (k, t): k, the set's size, two fingerprints, its prefix, and how many shingles of it aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, frequent = shared.value
        for full in batches:
            for batch in chunks(full, "t"):
                codes, level, cuts = _codes(batch.column("t"), levels, size)
                n = np.diff(cuts)
                total = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x)])
                one, two = total(mix(codes)), total(mix(codes ^ np.uint64(0x5851F42D4C957F2D)))
                keep = np.where(n > 0, n - _needed(n, percent) + 1, 0)
                within = np.arange(int(keep.sum())) - np.repeat(np.cumsum(keep) - keep, keep)
                at = np.repeat(cuts[:-1], keep) + within
                ends = np.concatenate([[0], np.cumsum(keep)])
                rare = np.concatenate([[0], np.cumsum(level[at] < frequent)])[ends]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k"),
                        pa.array(n.astype(np.int64)),
                        pa.array((one[cuts[1:]] - one[cuts[:-1]]).view(np.int64)),
                        pa.array((two[cuts[1:]] - two[cuts[:-1]]).view(np.int64)),
                        id_lists(codes[at].view(np.int64), ends, pa.int64()),
                        pa.array(np.diff(rare).astype(np.int64)),
                    ],
                    names=["k", "n", "f1", "f2", "codes", "rare"],
                )

    schema = T.StructType(
        [T.StructField("k", texts.schema["k"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")]
        + [T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("rare", T.LongType())]
    )
    return texts.select("k", "t").mapInArrow(run, schema)


def _required(na: Column, nb: Column, percent: int) -> Column:
    """Smallest overlap of similar sets of these sizes."""
    return F.ceil((na + nb) * percent / F.lit(100.0 + percent) - 1e-9)


def _possible(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar if their first common shingle has these positions."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - pa_, nb - pb) >= _required(na, nb, percent))


def _compare(size: int, percent: int):
    """Exact Jaccard distances of pairs of texts; the texts of a cell come before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for full in batches:
            for batch in chunks(full, "t"):
                cuts_of, hashes = distinct_per_text(*shingle_hashes(find_words(batch.column("t")), size), batch.num_rows)[::-1]
                out: list[tuple] = []
                columns = [batch.column(c).to_pylist() for c in ("cell", "a", "b", "is_pair")]
                for i, (here, x, y, is_pair) in enumerate(zip(*columns, strict=True)):
                    if here != cell:
                        cell, sets = here, {}
                    if not is_pair:
                        sets[x] = hashes[cuts_of[i] : cuts_of[i + 1]]
                        continue
                    one, two = sets[x], sets[y]
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    union = max(len(one) + len(two) - shared, 1)
                    out.append((x, y, 1 - shared / union, 100 * shared >= percent * union))
                kinds = [batch.schema.field("a").type, batch.schema.field("b").type, pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["a", "b", "dist", "linked"])

    return run


class _Verifier:
    """Exact comparison of pairs of representatives; of all texts only those of a pair are kept, in a table.

    Pairs that met in the same index list are compared in one place, so that a text goes there once for all of them;
    lists with many texts are cut into cells of two blocks of at most about ``CELL_TEXTS``.
    """

    def __init__(self, texts: DataFrame, size: int, percent: int):
        self.texts, self.size, self.percent = texts, size, percent
        self.steps: list[Step] = []

    def __call__(self, pairs: DataFrame) -> Step:
        """Pairs (a, b, s) with ``dist``, 1 - shared / union, and ``linked``."""
        pairs = Step(pairs.groupBy("a", "b").agg(F.min("s").alias("s")), "asked").df
        kind = pairs.schema["a"].dataType
        schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("dist", T.DoubleType()), T.StructField("linked", T.BooleanType())])
        if pairs.isEmpty():
            return Step(pairs.sparkSession.createDataFrame([], schema), "compared")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        if self.steps:
            ids = ids.join(self._texts().select("k"), "k", "left_anti")
        new = Step(ids, "ids")
        asked = new.df.count()
        if not self.steps or asked:
            ids = F.broadcast(new.df) if asked <= BROADCAST_KEYS else new.df  # texts stay where they are
            self.steps.append(Step(self.texts.join(ids, "k", "left_semi"), "texts"))
        new.drop()
        texts = self._texts()
        met = pairs.select("s", F.explode(F.array("a", "b")).alias("k")).distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n"))
        blocks = F.ceil(F.col("n") / CELL_TEXTS)
        block = lambda c: F.pmod(F.xxhash64(c), blocks)
        placed = pairs.join(met, "s").select("a", "b", F.xxhash64("s", block("a"), block("b")).alias("cell"))
        wanted = placed.select("cell", F.explode(F.array("a", "b")).alias("k")).distinct().join(texts, "k")
        none = F.lit(None)
        rows = wanted.select("cell", F.lit(False).alias("is_pair"), F.col("k").alias("a"), none.cast(kind).alias("b"), "t")
        rows = rows.unionByName(placed.select("cell", F.lit(True).alias("is_pair"), "a", "b", none.cast("string").alias("t")))
        dealt = rows.repartition("cell").sortWithinPartitions("cell", "is_pair")
        return Step(dealt.mapInArrow(_compare(self.size, self.percent), schema), "compared")

    def _texts(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.df for s in self.steps])

    def drop(self) -> None:
        for s in self.steps:
            s.drop()


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE
) -> DataFrame:
    """Columns ``key``, ``n_shingles`` and ``component_id``, one row per row of ``docs``; keys must be distinct.

    Documents are linked where 100 * shared >= percent * union of their distinct ``size``-word shingles; the component
    is the smallest key that links lead to. Shorter texts have their whole word sequence as one shingle; null texts
    and those without words have none and stay alone. Only the key and the text are read; null keys are kept, alone. A
    key named as a result is an error.
    """
    refuse_clashes(key, "n_shingles", "component_id")
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    shared = spark.sparkContext.broadcast(shingle_levels(texts, size))  # BUCKETS bytes
    same = ["f1", "f2", "n"]
    prefixes = Step(shingle_prefixes(texts, shared, size, percent), "prefixes")
    rows = Step(prefixes.df.select("k", *same), "sets")
    reps = prefixes.df.filter("n > 0 and k is not null").groupBy(*same).agg(F.min("k").alias("rep"), F.first("codes").alias("codes"), F.first("rare").alias("rare"))
    reps = Step(reps, "representatives")
    prefixes.drop()
    posting = reps.df.select(F.posexplode("codes").alias("pos", "s"), "rep", "n", "rare").withColumn("pos", F.col("pos").cast("long"))
    # Lists of shingles that aren't frequent are short, and most have a single entry.
    by_shingle = Window.partitionBy("s")
    several = posting.filter("pos < rare").withColumn("df", F.count(F.lit(1)).over(by_shingle)).filter("df > 1")
    several = several.withColumns({"salt": F.lit(-1), "long": F.col("df") > SHORT_LIST}).drop("df")
    frequent = posting.filter("pos >= rare").withColumns({"salt": F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"), "long": F.lit(True)})
    salted = several.unionByName(frequent)
    lists = Step(salted.drop("rare"), "lists")
    classes = Step(reps.df.select(*same, "rep"), "classes")
    reps.drop()

    compare = _Verifier(texts, size, percent)
    first = compare(_near_entries(lists.df, percent))
    links = first.df.filter("linked").select("a", "b")
    label = Step(components(_forest(links.coalesce(links.count() // FOREST_LINKS + 1))), "labels")
    known, label = _rounds(lists.df.filter("long"), first, label, compare, percent)
    second, third = _remaining(lists.df, known, label.df, compare, percent)
    # Later links join components that are known by now.
    late = second.df.filter("linked").select("a", "b").unionByName(third.df.filter("linked").select("a", "b"))
    final = label.df if late.isEmpty() else _merged(label.df, late)

    classes = classes.df.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(*[F.col(c).alias(f"r_{c}") for c in same], F.coalesce("component", "rep").alias("c"))
    match = (F.col("f1") == F.col("r_f1")) & (F.col("f2") == F.col("r_f2")) & (F.col("n") == F.col("r_n")) & F.col("k").isNotNull()
    out = rows.df.select("k", *same).join(classes, match, "left")
    compare.drop()
    lists.drop()
    collect_garbage(spark)
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("c", "k").alias("component_id"))


def _near_entries(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of each entry with the one before it and the first one of its list, or of its part of the list.

    Of each set, the ``PARTNERS`` it meets in most lists; later comparisons cover what this leaves open.
    """
    part = Window.partitionBy("s", "salt").orderBy("n", "rep")
    entry = F.struct("n", "rep", "pos")
    near = lists.withColumns({"before": F.lag(entry).over(part), "head": F.first(entry).over(part)})
    near = near.select("s", entry.alias("x"), F.explode(F.array_distinct(F.array("before", "head"))).alias("y")).filter("y is not null")
    heads = lists.filter("salt >= 0").groupBy("s", "salt").agg(F.min(entry).alias("y"))
    top = heads.groupBy("s").agg(F.min("y").alias("x"))
    across = heads.join(top, "s").select("s", "x", "y")
    pairs = near.unionByName(across)
    ok = _possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
    met = pairs.filter(ok).select("s", F.greatest("x.rep", "y.rep").alias("b"), F.least("x.rep", "y.rep").alias("a")).filter("a <> b")
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"), F.min("s").alias("s"))
    most = Window.partitionBy("b").orderBy(F.desc("lists"), "a")
    return met.withColumn("no", F.row_number().over(most)).filter(F.col("no") <= PARTNERS).select("a", "b", "s")


def _forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that join the same nodes: those of a task become stars around the smallest node of each of its groups.

    Each round of ``components`` is a number of jobs, and what the driver keeps of a run grows with these and their tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict = {}
        up: list[int] = []

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        def stars(kind: pa.DataType) -> pa.RecordBatch:
            nodes, least = list(number), {}
            for i, x in enumerate(nodes):
                r = find(i)
                least[r] = min(least.get(r, x), x)
            found = [(x, least[find(i)]) for i, x in enumerate(nodes) if x != least[find(i)]]
            number.clear()
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                ends = []
                for x in pair:
                    if (i := number.setdefault(x, len(up))) == len(up):
                        up.append(i)
                    ends.append(find(i))
                up[max(ends)] = min(ends)
            if len(up) > FOREST_NODES:
                yield stars(batch.schema.field("a").type)
        if up:
            yield stars(batch.schema.field("a").type)

    links = links.select("a", "b")
    return links.mapInArrow(run, links.schema)


def _between(label: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) of nodes as links of their components."""
    for s in ("a", "b"):
        links = links.join(label.select(F.col("node").alias(s), F.col("component").alias("c")), s, "left").withColumn(s, F.coalesce("c", s)).drop("c")
    return links.filter("a <> b")


def _moved(label: DataFrame, moved: DataFrame) -> DataFrame:
    """Components (node, component) after components have moved to others."""
    own = label.join(moved.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left")
    own = own.select("node", F.coalesce("c", "component").alias("component"))
    return own.unionByName(moved.join(label.select("node"), "node", "left_anti"))


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b)."""
    return _moved(label, components(_forest(_between(label, links))))


def _gathered(label: DataFrame, links: DataFrame) -> DataFrame:
    """As ``_merged``, in few jobs: components move to the smallest one within two links of them, if that one stays.

    What has the same label then is linked, but not all that is linked has the same label.
    """
    links = Step(_forest(_between(label, links)).distinct(), "links")
    both = links.df.unionByName(links.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("b")).agg(F.least("a", F.min("b")).alias("m"))
    moved = both.join(least, "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("component")).filter("node <> component")
    moved = Step(moved, "moved")
    links.drop()
    return _moved(label, moved.df.join(moved.df.select(F.col("node").alias("component")), "component", "left_anti").select("node", "component"))


def _both_ends(links: DataFrame) -> DataFrame:
    return links.select("a", "b", "dist").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))


def _rounds(lists: DataFrame, first: Step, label: Step, compare: _Verifier, percent: int) -> tuple[DataFrame, Step]:
    """All pairs compared so far and the components after rounds of comparisons; a round sees the links of those before.

    Between rounds components are gathered by one step, as what it leaves apart is only asked again; after the last
    round they are made whole.
    """
    lists = Step(lists.select("s", "rep", "n", "pos"), "long")
    known = first.df
    for turn in range(ROUNDS):
        found = compare(_round_pairs(lists.df, known, label.df, turn, percent))
        asked, links = found.df.agg(F.count(F.lit(1)), F.count_if("linked")).first()
        known = known.unionByName(found.df)
        last = links * LEAST_LINKS <= asked or turn == ROUNDS - 1
        if links and not last:
            label = Step(_gathered(label.df, found.df.filter("linked").select("a", "b")), "labels")
        if last:
            break
    known = Step(known, "known").df
    label = Step(_merged(label.df, known.filter("linked").select("a", "b")), "labels")
    lists.drop()
    return known, label


def _round_pairs(lists: DataFrame, known: DataFrame, label: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b, s) of entries of different components, new ones only, at most ``ROUND_PARTNERS`` for each asking set.

    Every entry may ask some of its list in each quarter octave of sizes next to its own: ``CENTRAL`` that were nearest to
    what they have been compared with, and two by hashes that differ from round to round; central ones come first.
    """
    compared = _both_ends(known).groupBy(F.col("a").alias("rep")).agg(((F.sum("dist") + PRIOR) / (F.count(F.lit(1)) + 1)).alias("mean"))
    named = lists.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").join(compared, "rep", "left")
    size = F.floor(4 * F.log2("n"))
    entries = named.select("s", "rep", "n", "pos", F.coalesce("component", "rep").alias("c"), F.coalesce("mean", F.lit(1.0)).alias("mean"), size.alias("size"))
    entry = F.struct("rep", "n", "pos", "c", "mean")
    central = Window.partitionBy("s", "size").orderBy("mean", "rep")
    best = entries.withColumn("no", F.row_number().over(central)).filter(F.col("no") <= CENTRAL).select("s", "size", entry.alias("y"))
    chance = [F.min_by(entry, F.struct(F.xxhash64(F.lit(2 * turn + i), "rep"), "rep")) for i in range(2)]
    picked = best.unionByName(entries.groupBy("s", "size").agg(F.array(*chance).alias("y")).select("s", "size", F.explode("y").alias("y")))
    asking = entries.select("s", "rep", "n", "pos", "c", F.explode(F.array(*[F.col("size") + i for i in (-1, 0, 1)])).alias("size"))
    met = asking.join(picked, ["s", "size"]).filter(F.col("c") != F.col("y.c"))
    met = met.filter(_possible(F.col("n"), F.col("pos"), F.col("y.n"), F.col("y.pos"), percent))
    met = met.groupBy("rep", F.col("y.rep").alias("y_rep")).agg(F.min("y.mean").alias("mean"), F.min("s").alias("s"))
    pairs = met.select("rep", F.least("rep", "y_rep").alias("a"), F.greatest("rep", "y_rep").alias("b"), "mean", "s")
    pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    nearest = Window.partitionBy("rep").orderBy("mean", "a", "b")
    return pairs.withColumn("no", F.row_number().over(nearest)).filter(F.col("no") <= ROUND_PARTNERS).select("a", "b", "s")


def _in_blocks(entries: DataFrame) -> DataFrame:
    """Entries (s, rep, n, pos, c) of lists with several components, with ``minor`` and the ``block`` of their list.

    The blocks of a long list have a quarter octave of sizes and a 64th of relative positions; very long lists are also
    parted by a hash, so that a block stays small. Short lists are one block.
    """
    mixed = entries.groupBy("s", "c").agg(F.count(F.lit(1)).alias("m"))
    major = mixed.groupBy("s").agg(F.max_by("c", F.struct("m", "c")).alias("major"), F.count(F.lit(1)).alias("groups"), F.sum("m").alias("entries"))
    sizes, places = F.floor(4 * F.log2("n")), F.floor(64 * F.col("pos") / F.col("n"))
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("entries") / PART_ENTRIES))
    block = F.when(F.col("entries") > LONG_LIST, (sizes * 64 + places) * (1 << 32) + part).otherwise(0)
    found = entries.join(major.filter("groups > 1"), "s")
    return found.select("s", "rep", "n", "pos", "c", (F.col("c") != F.col("major")).alias("minor"), block.alias("block"))


def _block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (s, block, y_block) of blocks of a list that may hold a similar pair; the second one has minor entries."""
    bounds = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("p"), F.min("c").alias("c"), F.max("c").alias("d"), F.max("minor").alias("minor")]
    blocks = entries.groupBy("s", "block").agg(*bounds)
    other = blocks.filter("minor").drop("minor").select(*[F.col(c).alias(f"y_{c}") for c in ("s", "block", "lo", "hi", "p", "c", "d")])
    ok = (F.col("s") == F.col("y_s")) & (F.col("hi") * 100 >= F.col("y_lo") * percent) & (F.col("y_hi") * 100 >= F.col("lo") * percent)
    ok &= F.least(F.col("hi") - F.col("p"), F.col("y_hi") - F.col("y_p")) >= _required(F.col("lo"), F.col("y_lo"), percent)
    ok &= (F.col("c") != F.col("d")) | (F.col("y_c") != F.col("y_d")) | (F.col("c") != F.col("y_c"))
    return blocks.join(other, ok).select("s", "block", "y_block")


def _members(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, s) of sets of different components that sizes and positions allow to be similar.

    Of a similar pair, the first common shingle always passes; each pair of blocks is a key of its own.
    """
    minor = entries.filter("minor").select(*[F.col(c).alias(f"y_{c}") for c in ("rep", "n", "pos", "c")], "s", F.col("block").alias("y_block"))
    met = entries.join(_block_pairs(entries, percent), ["s", "block"]).join(minor, ["s", "y_block"])
    met = met.filter((F.col("c") != F.col("y_c")) & (~F.col("minor") | (F.col("rep") < F.col("y_rep"))))
    met = met.filter(_possible(F.col("n"), F.col("pos"), F.col("y_n"), F.col("y_pos"), percent))
    return met.select(F.least("rep", "y_rep").alias("a"), F.greatest("rep", "y_rep").alias("b"), "s")


def _remaining(lists: DataFrame, known: DataFrame, label: DataFrame, compare: _Verifier, percent: int) -> tuple[Step, Step]:
    """What is left between sets that aren't linked yet: comparisons of their anchors, then of themselves."""
    label = label.withColumnRenamed("node", "rep")
    entries = lists.join(label, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component", "salt", "long")
    met = _members(_in_blocks(entries), percent).groupBy("a", "b").agg(F.min("s").alias("s"))
    open_ = Step(met.join(known.select("a", "b"), ["a", "b"], "left_anti"), "open")

    # The anchor of a set is the most linked set of its component if both are linked, else the set itself.
    ends = _both_ends(known.filter("linked"))
    degree = ends.groupBy("a").agg(F.count(F.lit(1)).alias("links")).join(label.withColumnRenamed("rep", "a"), "a", "left")
    leader = degree.groupBy(F.coalesce("component", "a").alias("c")).agg(F.max_by("a", F.struct("links", "a")).alias("anchor"))
    anchored = ends.join(leader.select(F.col("anchor").alias("b")), "b", "left_semi").select(F.col("a").alias("rep"), F.col("b").alias("anchor"), "dist")
    anchors = Step(anchored.groupBy("rep").agg(F.min(F.struct("dist", "anchor")).alias("x")).select("rep", "x.anchor", "x.dist"), "anchors")

    def with_anchor(df: DataFrame, side: str) -> DataFrame:
        own = anchors.df.select(F.col("rep").alias(side), F.col("anchor").alias(f"{side}x"), F.col("dist").alias(f"{side}d"))
        joined = df.join(own, side, "left")
        return joined.withColumns({f"{side}x": F.coalesce(f"{side}x", side), f"{side}d": F.coalesce(f"{side}d", F.lit(0.0))})

    placed = Step(with_anchor(with_anchor(open_.df, "a"), "b"), "placed")
    asked = placed.df.select(F.least("ax", "bx").alias("a"), F.greatest("ax", "bx").alias("b"), "s").filter("a <> b")
    second = compare(asked.join(known.select("a", "b"), ["a", "b"], "left_anti"))
    answers = known.unionByName(second.df).select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("dist").alias("apart"), "linked")
    judged = placed.df.withColumns({"lo": F.least("ax", "bx"), "hi": F.greatest("ax", "bx")}).join(answers, ["lo", "hi"], "left")
    limit = 1 - percent / 100 + 1e-9
    left_open = judged.filter("not coalesce(linked, false) and lo <> hi").filter(F.col("apart") - F.col("ad") - F.col("bd") <= limit)
    left_open = left_open.filter("ax <> a or bx <> b").select("a", "b", "s")
    third = compare(left_open)
    return second, third
