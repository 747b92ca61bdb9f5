"""Katz backoff: a bigram model with Good-Turing discounts, learned from and scored over distributed tables.

Counts of words and of pairs of classes are kept as tables. The most frequent words are classes of their own; every other
word, known or not, belongs to one of a fixed number of classes by its hash and has a share of its class by its own count.
So contexts have a bounded number and their backoff weights are broadcast, while counts grow with the corpus.

With c the count of a pair, C that of its context v: P(w|v) = d(c) c / C if the pair was seen, else a(v) P(w). P(w) is
again discounted and backs off to an equal share for classes never seen. a(v) is what the discounts leave, divided by the
sum of P(w) over what was not seen after v, so that all probabilities of a context sum to 1. Where discounts leave
nothing, the context counts once more; where nothing is left to back off to, its discounted counts are divided by their
sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.words import chunks, find_words, mix
from cairnfield.llm.work import Step

VOCABULARY = 1 << 20  # words that are classes of their own, at most
RARE_CLASSES = 1 << 18  # classes of all other words
DISCOUNTED = 5  # counts up to this are discounted
ADDED = 0.5  # to a word's count, in the base score and inside a class
BUCKET_TOKENS = 1 << 21  # of the corpus, on average, in a bucket of the table of pairs
SENT_BYTES = 1 << 19  # of texts whose pairs are sent at once
HOT_CONTEXT = 1 << 18  # a context with that count is dealt over all buckets
CHUNK_BYTES = 1 << 20  # of texts whose counts are added up before they are sent
END = 0  # of a text; as a context, its beginning
SHIFT = 22  # bits of a class in the code of a pair


def _how_many(counts: np.ndarray) -> np.ndarray:
    """How many of the counts are 0, 1, ... DISCOUNTED + 1."""
    return np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[:-1]


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discount by count, 0 to DISCOUNTED + 1 (1 from there on), from how many types occur 0, 1, ... times.

    Katz' renormalised form, so that the discounts save as much as the types seen once are worth. A count whose estimate
    isn't between 0 and 1 isn't discounted.
    """
    out = np.ones(DISCOUNTED + 2)
    if n[1]:
        rest = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        for r in range(1, DISCOUNTED + 1):
            if n[r] and rest < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest)
                out[r] = d if 0 < d <= 1 else 1.0
    return out


@dataclass
class Classes:
    """What is known of classes: broadcast, of bounded size."""

    hashes: np.ndarray  # of the words with a class of their own, sorted; their classes are 1, 2, ...
    rare: int
    counts: np.ndarray  # by class
    types: np.ndarray  # different words of each rare class
    own: np.ndarray | None = None  # log10 of P(w) by class
    buckets: int = 1

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word and whether it is its own."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        own = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        return np.where(own, at + 1, 1 + len(self.hashes) + (hashes % np.uint64(self.rare)).astype(np.int64)), own

    def pairs(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Text number and code of each token with the one before it."""
        texts, n = len(words.offsets) - 1, len(words.hashes)
        keys, back = np.unique(words.hashes, return_inverse=True)
        second = np.zeros(n + texts, np.int64)
        second[np.arange(n) + words.doc] = self.of(keys)[0][back]
        first = np.concatenate([[END], second[:-1]])  # a text's beginning follows the end of the one before
        return np.repeat(np.arange(texts), np.diff(words.first) + 1), first << SHIFT | second

    def bucket(self, codes: np.ndarray) -> np.ndarray:
        context = codes >> SHIFT
        spread = np.where(self.counts[context] >= HOT_CONTEXT, codes, context)
        return (mix(spread.astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)

    def log_share(self) -> np.ndarray:
        """log10 of the number that a word's count plus ADDED is divided by, inside each rare class."""
        rare = self.counts[1 + len(self.hashes) :]
        return np.log10(rare + ADDED * (self.types + 1))


@dataclass
class KatzModel:
    words: DataFrame  # h, c: every word of the corpus by its hash
    pairs: DataFrame  # bucket, codes, counts: sorted codes of pairs and their counts, as bytes
    classes: Classes
    discounts: np.ndarray  # of pairs, by count
    backoff: np.ndarray  # log10 of a(v) by context
    divisor: np.ndarray  # log10 of what a discounted count is divided by, by context
    tokens: int
    texts: int
    distinct: int  # tokens, the end included


_CODEC = pa.Codec("lz4")


def _pack(a: np.ndarray) -> bytes:
    """Numbers as planes of bytes, of which the upper ones are almost empty, compressed; the number of bytes before them."""
    planes = a.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(planes).to_bytes(8, "little") + _CODEC.compress(planes, asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    planes = _CODEC.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"))
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=np.int64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """One row after the other, so that only one is held beside its batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): how often each word occurs in all texts, by its hash; the null hash counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "t", CHUNK_BYTES):
                keys, n = np.unique(find_words(batch.column("t")).hashes, return_counts=True)
                h = pa.concat_arrays([pa.array(keys.view(np.int64)), pa.array([None], pa.int64())])
                yield pa.RecordBatch.from_arrays([h, pa.array(np.append(n, batch.num_rows).astype(np.int64))], names=["h", "c"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _classes(words: DataFrame, texts: int, vocabulary: int, rare: int) -> Classes:
    """The most frequent words, as many as fit if equal counts go together, and the sums of the rare classes."""
    coarse = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.expr("shiftleft(1L, length(bin(c)) - 1)"))  # few groups at any size
    room, least = vocabulary, 1 << 62
    for r in sorted(words.groupBy(coarse.alias("c")).count().collect(), reverse=True):
        room -= r[1]
        if room < 0:
            break
        least = r.c
    own = words.filter(F.col("c") >= least).toArrow()  # bounded by ``vocabulary``
    hashes, c = own.column("h").to_numpy().view(np.uint64), own.column("c").to_numpy()
    order = np.argsort(hashes)
    others = words.filter(F.col("c") < least).groupBy(F.pmod("h", F.lit(rare)).alias("k")).agg(F.sum("c").alias("c"), F.count("c").alias("types")).toArrow()
    sums, types = np.zeros(rare, np.int64), np.zeros(rare, np.int64)
    sums[others.column("k").to_numpy()] = others.column("c").to_numpy()
    types[others.column("k").to_numpy()] = others.column("types").to_numpy()
    return Classes(hashes[order], rare, np.concatenate([[texts], c[order], sums]), types)


def _own_log_probs(counts: np.ndarray) -> np.ndarray:
    discounts = good_turing(_how_many(counts))
    mass = discounts[np.minimum(counts, DISCOUNTED + 1)] * counts
    unseen = int((counts == 0).sum())
    total = counts.sum() if mass.sum() < counts.sum() * (1 - 1e-12) else counts.sum() + 1
    if not unseen:
        return np.log10(mass / mass.sum())
    return np.log10(np.where(counts == 0, (1 - mass.sum() / total) / unseen, mass / total))


def fit(docs: DataFrame, text: str = "text", vocabulary: int = VOCABULARY, rare_classes: int = RARE_CLASSES) -> KatzModel:
    """The model of all texts of a table; a null text is an empty one, whose only token is its end.

    Words are lower-cased (A-Z) runs of bytes other than space and 0x09-0x0D. Other columns aren't read; without rows,
    all classes are equally likely.
    """
    if rare_classes & (rare_classes - 1) or 1 + vocabulary + rare_classes > 1 << SHIFT - 1:
        raise ValueError("rare_classes must be a power of two and fit, with the vocabulary, into a code")
    counted = Step(count_words(docs, text), "words").df
    words = counted.filter(F.col("h").isNotNull())
    sums = counted.agg(F.sum(F.when(F.col("h").isNull(), F.col("c"))), F.sum("c"), F.count(F.lit(1))).first()
    texts, tokens = sums[0] or 0, sums[1] or 0
    classes = _classes(words, texts, vocabulary, rare_classes)
    classes.own = _own_log_probs(classes.counts)
    classes.buckets = max(1, -(-tokens // BUCKET_TOKENS))
    pairs = Step(_count_pairs(docs, text, classes), "pairs").df
    n = pairs.agg(*[F.sum(F.element_at("n", r + 1)) for r in range(DISCOUNTED + 2)]).first()
    discounts = good_turing(np.array([x or 0 for x in n]))
    backoff, divisor = _contexts(pairs, classes, discounts)
    return KatzModel(words, pairs, classes, discounts, backoff, divisor, tokens, texts, sums[2])


def _count_pairs(docs: DataFrame, text: str, classes: Classes) -> DataFrame:
    """(bucket, codes, counts, n): one row per bucket; n are its pairs that occur 0, 1, ... times."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    kind = "bucket int, codes binary, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "t", CHUNK_BYTES):
                codes, n = np.unique(shared.value.pairs(find_words(batch.column("t")))[1], return_counts=True)
                bucket = shared.value.bucket(codes)
                order = np.argsort(bucket, kind="stable")
                numbers, cuts = np.unique(bucket[order], return_index=True)
                parts = [(int(b), _pack_sorted(codes[i]), _pack(n[i])) for b, i in zip(numbers, np.split(order, cuts[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "codes", "counts"])

    def add(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        codes, back = np.unique(np.concatenate([_unpack_sorted(r[0]) for r in rows]), return_inverse=True)
        return codes, np.bincount(back, np.concatenate([_unpack(r[1]) for r in rows]), len(codes)).astype(np.int64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            codes, n = add(rows)
            return pa.RecordBatch.from_pylist([{"bucket": at, "codes": _pack_sorted(codes), "counts": _pack(n), "n": _how_many(n).tolist()}], schema=schema)

        schema = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()), ("n", pa.list_(pa.int64()))])
        at, rows, held = None, [], 0
        for b, codes, n in _rows(batches):
            if b != at and rows:
                yield made()
                rows, held = [], 0
            at = b
            rows.append((codes, n))
            held += int.from_bytes(n[:8], "little")
            if held > 32 * BUCKET_TOKENS:  # what has come so far is added up
                rows, held = [(_pack_sorted(so_far), _pack(m)) for so_far, m in (add(rows),)], 0
        if rows:
            yield made()

    parts = docs.select(F.col(text).alias("t")).mapInArrow(count, kind)
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, f"{kind}, n array<long>")


def _contexts(pairs: DataFrame, classes: Classes, discounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of backoff weight and divisor of each context."""
    shared = pairs.sparkSession.sparkContext.broadcast((classes.own, discounts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, discount = shared.value
        for packed, n in _rows(batches):
            codes, n = _unpack_sorted(packed), _unpack(n)
            v, first = np.unique(codes >> SHIFT, return_index=True)  # codes are sorted
            kept = np.add.reduceat(discount[np.minimum(n, DISCOUNTED + 1)] * n, first)
            lower = np.add.reduceat(10 ** own[codes & (1 << SHIFT) - 1], first)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(kept), pa.array(lower), pa.array(np.diff(np.append(first, len(codes))))], names=["v", "kept", "lower", "types"])

    rows = pairs.select("codes", "counts").mapInArrow(run, "v long, kept double, lower double, types long")
    found = rows.groupBy("v").agg(*[F.sum(c).alias(c) for c in ("kept", "lower", "types")]).toArrow()  # a row per class at most
    v, kept, lower, types = (found.column(c).to_numpy() for c in ("v", "kept", "lower", "types"))
    counts = classes.counts[v]
    total = np.where(kept < counts * (1 - 1e-12), counts, counts + 1.0)
    total = np.where(types == len(classes.counts), kept, total)  # nothing is left to back off to
    left = np.maximum(1 - kept / total, 0)
    backoff, divisor = np.zeros(len(classes.counts)), np.zeros(len(classes.counts))
    some = (left > 0) & (types < len(classes.counts))
    backoff[v[some]] = np.log10(left[some]) - np.log10(np.maximum(1 - lower[some], 1e-300))
    divisor[v] = np.log10(total)
    return backoff, divisor


def _by_text(docs: DataFrame, key: str, text: str, model: KatzModel) -> DataFrame:
    """(uid, key, n_tokens, known, base, share, rare, rare_n) of each text.

    ``known`` and ``base`` (sum of log10 of count + ADDED) are of the end and of words that are their own class; ``rare``
    and ``rare_n`` are the others with their numbers, ``share`` the sum of what they are divided by in their class.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.classes.log_share()))
    names = ["uid", "k", "n_tokens", "known", "base", "share", "rare", "rare_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, log_share = shared.value
        end = np.log10(classes.counts[END] + ADDED)
        for whole in batches:
            for batch in chunks(whole, "t", SENT_BYTES):
                texts = batch.num_rows
                words = find_words(batch.column("t"))
                keys, back = np.unique(words.hashes, return_inverse=True)
                kind, own = classes.of(keys)
                value = np.where(own, np.log10(classes.counts[kind] + ADDED), 0.0)
                share = np.where(own, 0.0, log_share[np.maximum(kind - 1 - len(classes.hashes), 0)])
                per = lambda x: np.bincount(words.doc, x[back], texts)  # noqa: E731, B023
                one, n = np.unique(words.doc[~own[back]] * len(keys) + back[~own[back]], return_counts=True)
                cuts = pa.array(np.searchsorted(one, np.arange(texts + 1) * len(keys)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (keys[one % max(len(keys), 1)].view(np.int64), n.astype(np.int64))]
                known = per(own.astype(float)).astype(np.int64) + (classes.counts[END] > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid"), batch.column("k"), pa.array(np.diff(words.first) + 1), pa.array(known), pa.array(per(value) + end), pa.array(-per(share)), *lists], names=names
                )

    longs = T.ArrayType(T.LongType())
    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), longs, longs)
    fields = [T.StructField("uid", T.LongType()), T.StructField("k", docs.schema[key].dataType), *map(T.StructField, names[2:], kinds)]
    out = T.StructType(fields)
    return _with_uid(docs, key, text).mapInArrow(run, out)


def _with_uid(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(uid, k, t): the id is a hash of key and text, so that it is the same whenever a row is read; equal rows share it."""
    return docs.select(F.xxhash64(F.col(key), F.col(text)).alias("uid"), F.col(key).alias("k"), F.col(text).alias("t"))


def _pair_scores(docs: DataFrame, key: str, text: str, model: KatzModel) -> DataFrame:
    """(uid, pair_score): log10 probabilities of the classes of a text's tokens, summed over all its copies.

    Pairs of a chunk of texts go to the buckets that hold their counts. Sums by text come back as one row for each chunk
    and bucket, and are added up by chunk, then by text.
    """
    context = docs.sparkSession.sparkContext
    classes = context.broadcast(model.classes)
    tables = context.broadcast((model.classes.own, model.discounts, model.backoff, model.divisor))
    kind = "bucket int, asks boolean, codes binary, counts binary, texts binary, uids binary, chunk long"
    types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "t", SENT_BYTES):
                doc, codes = classes.value.pairs(find_words(batch.column("t")))
                uids = batch.column("uid").to_numpy()
                order = np.lexsort((doc, codes))
                doc, codes = doc[order], codes[order]
                first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])))
                n = np.diff(np.append(first, len(codes)))
                doc, codes = doc[first], codes[first]
                bucket = classes.value.bucket(codes)
                order = np.argsort(bucket, kind="stable")
                numbers, cuts = np.unique(bucket[order], return_index=True)
                parts = []
                for b, i in zip(numbers, np.split(order, cuts[1:]), strict=True):
                    there, at = np.unique(doc[i], return_inverse=True)
                    parts.append((int(b), True, _pack_sorted(codes[i]), _pack(n[i]), _pack(at), _pack(uids[there]), int(uids[0])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names=[c.split()[0] for c in kind.split(", ")])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, discount, backoff, divisor = tables.value
        at, known, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b, asks, packed, n, texts, uids, chunk in _rows(batches):
            if b != at:
                at, known, counts = b, np.zeros(0, np.int64), np.zeros(0, np.int64)
            if not asks:
                known, counts = _unpack_sorted(packed), _unpack(n)
                continue
            codes, n, doc = _unpack_sorted(packed), _unpack(n), _unpack(texts)
            place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            seen = known[place] == codes if len(known) else np.zeros(len(codes), bool)
            c = np.where(seen, counts[place] if len(known) else 1, 1)
            v, w = codes >> SHIFT, codes & (1 << SHIFT) - 1
            score = np.where(seen, np.log10(discount[np.minimum(c, DISCOUNTED + 1)] * c) - divisor[v], backoff[v] + own[w])
            sums = pa.array([np.bincount(doc, score * n).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([uids], pa.binary()), sums], names=["chunk", "uids", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), lambda r: r[0]):
            uids, sums = np.zeros(0, np.int64), np.zeros(0)
            for part in iter(lambda: list(islice(rows, 64)), []):
                uids, back = np.unique(np.concatenate([uids, *(_unpack(r[1]) for r in part)]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([sums, *(np.frombuffer(r[2]) for r in part)]), len(uids))
            yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(sums)], names=["uid", "score"])

    asked = _with_uid(docs, key, text).select("uid", "t").mapInArrow(send, kind)
    none = F.lit(None).cast("binary")
    table = model.pairs.select("bucket", F.lit(False).alias("asks"), "codes", "counts", none.alias("texts"), none.alias("uids"), F.lit(None).cast("long").alias("chunk"))
    met = table.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "asks")
    found = met.mapInArrow(look, "chunk long, uids binary, sums binary").repartition("chunk").sortWithinPartitions("chunk")
    return found.mapInArrow(add, "uid long, score double").groupBy("uid").agg(F.sum("score").alias("pair_score"))


def score(docs: DataFrame, model: KatzModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, n_tokens, n_known, train_tokens, base_score, score of every row; both scores are log10 sums.

    ``base_score`` is of single tokens with ADDED added to every count and one token unknown; ``score`` is the model's.
    A null text is an empty one. Repeated rows give repeated results; null keys are keys. A key named as a result is an
    error; other columns aren't read.
    """
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if key in results:
        raise ValueError(f"the key clashes with results: {key}")
    rows = Step(_by_text(docs, key, text, model), "texts").df
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("m"))
    rare = rare.join(model.words, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("uid").agg(F.sum(F.col("m") * F.log10(F.col("c") + ADDED)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("rare_known"))
    sums = _pair_scores(docs, key, text, model).join(rows.groupBy("uid").agg(F.count(F.lit(1)).alias("copies")), "uid")
    found = rows.select("uid", "k", "n_tokens", "known", "base", "share").join(sums, "uid").join(rare, "uid", "left")
    copies = F.col("copies")  # sums by uid hold all copies of a row
    rare_log = F.coalesce(F.col("rare_log") / copies, F.lit(0.0))
    total = float(np.log10(model.tokens + ADDED * (model.distinct + 1)))
    return found.select(
        F.col("k").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce(F.round(F.col("rare_known") / copies), F.lit(0.0)).cast("long")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("pair_score") / copies + F.col("share") + rare_log).alias("score"),
    )


def held_out(key: Column) -> Column:
    """Whether a document may not be learned from: crc32 of its key as text leaves 1 when divided by 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1
