"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word's probability in a language is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words (runs of letters,
lower-cased). Distinct words are scored once and kept by their worker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.pieces import best_paths, lattice, total_scores
from cairnfield.llm.sentencepieces import BLOCK_WORDS, PieceModel, broadcast_model
from cairnfield.llm.work import refuse_clashes
from cairnfield.llm.words import KeyCache, chunks, find_words, span_hashes, text_buffer

UNDETERMINED = "und"
PER_LANGUAGE = 4000  # documents of a language to learn from, as expected over a hash of the key
SMOOTHING = 0.5
UNKNOWN_LOG_PROB = -14.0  # of a character without a piece, alike in all languages

_LETTER_OR_HIGH = np.zeros(256, np.uint8) + 32
_LETTER_OR_HIGH[97:123] = np.arange(97, 123)
_LETTER_OR_HIGH[128:] = np.arange(128, 256)


def _word_spans(texts: pa.Array):
    """Words of lower-cased texts: runs of a-z and non-ASCII characters, each with a space before it."""
    raw, offsets = text_buffer(pc.utf8_lower(texts))
    data = _LETTER_OR_HIGH[raw]
    # A space at the front of the buffer, so that every word has one before it to mark its beginning.
    plain = pa.Array.from_buffers(
        pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    )
    return find_words(plain, lower=False)


def _marked(words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the chosen words with a space before each, and their spans."""
    sizes = words.ends[which] - words.starts[which]
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    data = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    data[np.repeat(starts + 1, sizes) + inner] = words.data[np.repeat(words.starts[which], sizes) + inner]
    return data, starts, ends


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter (Unicode category L); null has none."""
    raw, offsets = text_buffer(texts)
    ascii_letter = ((raw | 0x20) >= 97) & ((raw | 0x20) <= 122) & (raw < 128)
    count = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = count[offsets[1:]] > count[offsets[:-1]]
    high = np.concatenate([[0], np.cumsum(raw >= 128)])
    for i in np.flatnonzero(~found & (high[offsets[1:]] > high[offsets[:-1]])):
        found[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _sampled(df: DataFrame, key: str, lang: str, per_language: int) -> DataFrame:
    """Rows to learn from: about ``per_language`` of each language, chosen by a hash of the key."""
    share = df.groupBy(lang).agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count(F.lit(1))).alias("_share"))
    draw = F.pmod(F.xxhash64(F.lit("learn"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(share), lang).filter(draw < F.col("_share")).drop("_share")  # a row per language


def learn(
    df: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    model: Broadcast | None = None,
) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities (one row per vocabulary id, one column per language).

    Rows with null text or language teach nothing. Pieces are counted over the best segmentations of the words of
    about ``per_language`` rows of each language. What is fetched has one row per language and piece.
    """
    model = model or broadcast_model(df.sparkSession, path)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = _sampled(rows.filter(F.col("t").isNotNull() & F.col("l").isNotNull()), "k", "l", per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: PieceModel = model.value
        counts: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in chunks(whole, "t"):
                langs = np.array(batch.column("l").to_pylist(), object)
                words = _word_spans(batch.column("t"))
                names, code = np.unique(langs, return_inverse=True)
                _, where, back = np.unique(words.hashes, return_index=True, return_inverse=True)
                uses = [np.bincount(back[code[words.doc] == c], minlength=len(where)) for c in range(len(names))]
                for some in np.array_split(np.arange(len(where)), -(-len(where) // BLOCK_WORDS) or 1):
                    lat = lattice(pieces.trie, *_marked(words, where[some]))
                    edges, cuts = best_paths(lat, pieces.scores, pieces.unknown)
                    piece = lat.piece[edges]
                    for name, use in zip(names, uses, strict=True):
                        weight = np.repeat(use[some], np.diff(cuts))
                        mine = np.bincount(piece[piece >= 0], weight[piece >= 0], len(pieces.scores))
                        counts[name] = counts.get(name, 0) + mine
        for name, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(mine[at], pa.float64())], names=["l", "p", "n"]
            )

    counted = rows.select("t", "l").mapInArrow(run, "l string, p long, n double").groupBy("l", "p").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    names = sorted(set(found.column("l").to_pylist()))
    table = np.zeros((len(model.value.scores), len(names)))
    column = {n: i for i, n in enumerate(names)}
    table[found.column("p").to_numpy(), [column[n] for n in found.column("l").to_pylist()]] = found.column("n").to_numpy()
    table += SMOOTHING
    return names, np.log(table) - np.log(table.sum(axis=0))


_caches: dict[int, KeyCache] = {}


def predict(
    df: DataFrame,
    path: str,
    languages: list[str],
    log_probs: np.ndarray,
    key: str = "doc_id",
    text: str = "text",
    model: Broadcast | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Columns ``key``, those of ``keep``, ``lang_pred`` and ``score`` (probability of that language, all being equally likely before).

    A null text, one without a letter, or a model without languages gives ``und`` and 0. Equal scores go to the first
    language by name. Only the key and the text are read; repeated rows give repeated results. Columns of one name are
    an error.
    """
    refuse_clashes(key, *keep, "lang_pred", "score")
    spark = df.sparkSession
    model = model or broadcast_model(spark, path)
    shared = spark.sparkContext.broadcast((languages, log_probs, hash(log_probs.tobytes())))
    unknown = np.full(len(languages), UNKNOWN_LOG_PROB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: PieceModel = model.value
        names, table, token = shared.value
        if token not in _caches:
            _caches.clear()
            _caches[token] = KeyCache(len(names))
        cache = _caches[token]
        for whole in batches:
            for batch in chunks(whole, "t"):
                texts = batch.column("t")
                best, sure = np.zeros(len(texts), int), np.zeros(len(texts))
                lettered = has_letter(texts) if names else np.zeros(len(texts), bool)
                if lettered.any():
                    words = _word_spans(texts)
                    keys, where, back = np.unique(words.hashes, return_index=True, return_inverse=True)
                    at, known = cache.find(keys)
                    rows = np.zeros((len(keys), len(names)))
                    rows[known] = cache.rows[at[known]]
                    new = np.flatnonzero(~known)
                    if len(new):
                        for some in np.array_split(new, -(-len(new) // BLOCK_WORDS)):
                            rows[some] = total_scores(lattice(pieces.trie, *_marked(words, where[some])), table, unknown)
                        cache.add(keys[new], rows[new])
                    sums = np.zeros((len(texts), len(names)))
                    _add_by_text(sums, words.first, rows[back])
                    best = sums.argmax(axis=1)
                    sure = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                label = [names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array(label, pa.string()), pa.array(np.where(lettered, sure, 0.0))], names=schema.names
                )

    kept = [df.schema[c] for c in (key, *keep)]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(F.col(text).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate((key, *keep))]).mapInArrow(run, schema)


def _add_by_text(sums: np.ndarray, first: np.ndarray, rows: np.ndarray) -> None:
    filled = np.flatnonzero(np.diff(first))
    sums[filled] = np.add.reduceat(rows, first[:-1][filled], axis=0)


def held_out(key: Column) -> Column:
    """Whether a document may not be learned from: crc32 of its key as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2
