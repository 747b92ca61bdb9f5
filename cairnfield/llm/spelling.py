"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Grams that are frequent among the words are extended by a character, up to ``LONGEST``, so that no list of the index is
long. A word is cut into the longest grams of that dictionary, those inside another left out. From the dictionary follows
for each word how many of its grams one edit can affect at most; all others are in the near word, too. So of that many
grams and one more, rarest first, two near words share one at matching places: those lists are merged, and what meets is
verified by its edit distance.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.words import chunks, find_words, mix, text_buffer
from cairnfield.llm.work import Step

SHORTEST, LONGEST = 2, 4  # characters of a gram
LEAST_FREQUENT = 16  # times that a gram must be in words before it is extended
DICTIONARY = 1 << 9  # bound of the extended grams of one length; the frequency needed follows from it
CHUNK_BYTES = 4 << 20
LONG_WORD = 64  # bytes from which a checksum is taken word by word
ENDS_IN = 97  # a run is misspelled if this divides its checksum

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def letter_runs(texts: pa.Array):
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF of every text, A-Z lowered; other bytes become spaces."""
    raw, offsets = text_buffer(texts)
    high = raw == 0xC3  # the first byte of U+00C0 to U+00FF and of nothing else
    inside = (((raw | 0x20) >= 97) & ((raw | 0x20) <= 122)) | high
    inside[1:] |= high[:-1]
    data = np.where(inside, raw, np.uint8(32))
    plain = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return find_words(plain)


def checksums(prefixes: list[bytes], of: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of ``prefixes[of] + data[start:end]``."""
    state = np.array([zlib.crc32(p) ^ 0xFFFFFFFF for p in prefixes], np.uint32)[of]
    sizes = ends - starts
    short = np.flatnonzero(sizes <= LONG_WORD)
    short = short[np.argsort(-sizes[short], kind="stable")]
    left = np.searchsorted(-sizes[short], -np.arange(1, LONG_WORD + 1), side="right")  # words of at least so many bytes
    for j, n in enumerate(left):
        at = short[:n]
        state[at] = _CRC[(state[at] ^ data[starts[at] + j]) & 0xFF] ^ (state[at] >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), zlib.crc32(prefixes[of[i]]))
    return out


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(starts - cuts[:-1], sizes) + np.arange(int(cuts[-1]))]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.string())


def misspelled_words(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 5, ends_in: int = ENDS_IN) -> DataFrame:
    """(word, n): letter runs of all texts of at least ``min_chars`` characters, and how often they occur.

    With h = crc32 of ``key:run``, a run whose h is a multiple of ``ends_in`` loses its character h % length first. A
    null text has no runs, a null key is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "t", CHUNK_BYTES):
                found = letter_runs(batch.column("t"))
                _, where, times = np.unique(mix(found.hashes ^ mix(found.doc.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
                starts, ends = found.starts[where], found.ends[where]
                sums = checksums([f"{k}:".encode() for k in batch.column("k").to_pylist()], found.doc[where], found.data, starts, ends)
                high = np.concatenate([[0], np.cumsum(found.data == 0xC3)])
                chars = ends - starts - (high[ends] - high[starts])
                hit = sums % ends_in == 0
                odd: dict[str, int] = {}
                for i in np.flatnonzero(hit & (chars > min_chars)):
                    word, at = found.data[starts[i] : ends[i]].tobytes().decode(), int(sums[i]) % int(chars[i])
                    word = word[:at] + word[at + 1 :]
                    odd[word] = odd.get(word, 0) + int(times[i])
                plain = np.flatnonzero(~hit & (chars >= min_chars))
                _, first, back = np.unique(found.hashes[where[plain]], return_index=True, return_inverse=True)
                n = np.bincount(back, times[plain], len(first)).astype(np.int64)
                words = _strings(found.data, starts[plain[first]], ends[plain[first]])
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(list(odd), pa.string()), pa.array(list(odd.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class GramDictionary:
    """All grams of ``SHORTEST`` characters, and those of up to ``LONGEST`` whose beginning is in ``extended``."""

    def __init__(self, extended: dict[str, int]):
        self.extended = extended  # with their frequencies; parts of an extended gram are extended themselves
        self.suffixes = {g[i:] for g in extended for i in range(1, len(g))}

    def cut(self, word: str) -> list[tuple[int, str]]:
        """(place, gram): the longest gram from each place, unless the one before reaches as far."""
        grams, last = [], 0
        for p in range(len(word) - SHORTEST + 1):
            end = p + SHORTEST
            while end < len(word) and end - p < LONGEST and word[p:end] in self.extended:
                end += 1
            if end > last:
                grams.append((p, word[p:end]))
                last = end
        return grams

    def affected(self, word: str, grams: list[tuple[int, str]]) -> int:
        """How many of the word's grams a single edit can destroy or hide at most, wherever it is.

        Left of an edit, a gram is safe unless a gram that begins no later can be extended across the edit; right of it,
        unless a gram from across the edit can cover it.
        """
        n, most = len(word), 0
        starts, ends = [p for p, _ in grams], [p + len(g) for p, g in grams]
        crossing = []  # by place: where the first gram begins that could be longer with other characters from there on
        covered = []  # by place: how far a gram from before it could reach
        for i in range(n + 1):
            p, e = i - SHORTEST, 1  # parts of extended grams are extended, so the first gram that isn't ends the search
            while p >= 0 and i - p < LONGEST and word[p:i] in self.extended:
                p -= 1
            while e < LONGEST - 1 and i + e < n and word[i : i + e] in self.suffixes:
                e += 1
            crossing.append(p + 1 if p < i - SHORTEST else i)
            covered.append(i + e)
        for i in range(n + 1):
            first = min(bisect_left(starts, crossing[i]), bisect_right(ends, i))
            for j in (i, i + 1)[: 1 + (i < n)]:  # inserted at i; deleted or replaced there
                most = max(most, bisect_left(starts, j) - first, bisect_right(ends, covered[j]) - first)
        return most

    def rarest(self, word: str) -> tuple[list[tuple[int, str]], bool]:
        """As many grams as one edit can affect and one more, rarest first; whether that is fewer than all and so enough."""
        grams = self.cut(word)
        most = self.affected(word, grams)
        ordered = sorted(grams, key=lambda g: (self.extended.get(g[1], 0), zlib.crc32(g[1].encode()), g[1], g[0]))
        return ordered[: most + 1], most < len(grams)


def gram_dictionary(words: DataFrame, least: int = LEAST_FREQUENT, bound: int = DICTIONARY) -> GramDictionary:
    """The dictionary of a table of words, pruned by frequency.

    A gram is extended if it is in words more than ``least`` times and often enough that at most ``bound`` grams of one
    length can be: of length L there are no more than all places in all words, divided by that frequency.
    """
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    frequency = max(least, -(-places // bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for word in batch.column("word").to_pylist():
                for q in range(SHORTEST, LONGEST):
                    found.update(word[i : i + q] for i in range(len(word) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])

    grams = words.select("word").mapInArrow(run, "gram string, n long")
    frequent = grams.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > frequency)
    return GramDictionary({r.gram: r.n for r in frequent.collect()})


def near_pairs(words: DataFrame, dictionary: GramDictionary) -> DataFrame:
    """(a, b, n_a, n_b): each pair of distinct words of the table that are one edit apart, once.

    Near words share a gram that the edit doesn't touch, so the edit is in what stands before or what stands after it,
    and there in the first or the second half: the rest of both words is equal. So the list of a gram is split by that
    rest, four lists for each gram; longer words ask in those of words one character shorter. Two words in both of which
    an edit may affect all grams meet in what is left of them without one character; all their grams are in the index,
    too, as a near word may have one that no edit affects.
    """
    shared = words.sparkSession.sparkContext.broadcast(dictionary)
    schema = pa.schema([("list", pa.string()), ("size", pa.int32()), ("asks", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 8192) for at in range(0, whole.num_rows, 8192)):
                rows = []
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    grams, enough = shared.value.rarest(word)
                    for size, asks in ((len(word), False), (len(word) - 1, True)):
                        rows += [(x, size, asks, word, n) for x in lists(word, grams, asks)]
                    if not enough:
                        rows += [(x, -1, False, word, n) for x in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    index = words.select("word", "n").mapInArrow(run, "list string, size int, asks boolean, word string, n long")
    index = Step(index.select(F.xxhash64("list", "size").alias("list"), "asks", "word", "n"), "grams").df
    there = index.filter(~F.col("asks")).select("list", F.col("word").alias("a"), F.col("n").alias("n_a"))
    asked = index.withColumnsRenamed({"word": "b", "n": "n_b"})
    ordered = F.col("asks") | (F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))
    near = (F.length("a") > LONG_WORD) | (F.levenshtein("a", "b", 1) == 1)
    met = there.join(asked, "list").filter(ordered & near).select("a", "b", "n_a", "n_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spark's edit distance takes time by the square of a word's length, also with a bound: long words come here."""
        for batch in batches:
            pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            yield batch.filter(pa.array([len(a) <= LONG_WORD or one_edit(a, b) for a, b in pairs], pa.bool_()))

    return met.mapInArrow(verify, met.schema).distinct()


def lists(word: str, grams: list[tuple[int, str]], longer: bool) -> set[str]:
    """Word without the half of what stands before or after each gram, as among words of its size or one shorter."""
    n, found = len(word), set()
    for p, g in grams:
        e = p + len(g)
        for begin, end in ((0, p), (e, n)):
            if size := end - begin - longer:  # of that part in the shorter word
                found |= {word[: begin + size // 2] + "|" + word[end:], word[:begin] + "|" + word[end - (size + 1) // 2 :]}
            elif size == 0:
                found.add(word[:begin] + "|" + word[end:])
    return found


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one character must be inserted, deleted or replaced; ``a`` is not longer than ``b``."""
    if a == b or len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)  # their common front by halving: comparing slices is fast
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: forms are followed by twice as many steps each round."""
    now = Step(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.df.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = Step(moved, "roots")
        now.drop()
        now = step
        if not step.df.filter("moved").limit(1).count():
            return step.df.select("word", "root")


def group_variants(words: DataFrame, min_n: int = 3, factor: int = 2) -> DataFrame:
    """Columns word, n, n_near, form, form_n, root of every word of (word, n) with at least ``min_n`` occurrences.

    ``form`` is the near word (one edit apart) with the largest n, of equals the least by code points, if that is at
    least ``factor`` times the word's n; ``root`` is the end of the chain of forms, the word itself if it has none.
    Words must be distinct and have ``SHORTEST`` characters; null words and counts aren't words. Other columns aren't read.
    """
    kept = words.filter(F.col("word").isNotNull() & (F.length("word") >= SHORTEST) & (F.col("n") >= min_n))
    known = Step(kept.select("word", "n"), "words").df
    pairs = near_pairs(known, gram_dictionary(known))
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")).alias("near"), F.col("n_a").alias("own"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("near")).alias("near"), F.col("n_b").alias("own")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"), F.first("own").alias("own"))
    enough = -F.col("best.less") >= factor * F.col("own")
    best = best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    best = Step(best, "forms").df
    out = known.join(best, "word", "left").join(_roots(best.filter(F.col("form").isNotNull())), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
