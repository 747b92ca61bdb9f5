"""Unigram encoding into the pieces of a public vocabulary, and decoding back to the same text.

Viterbi search over a double-array trie finds the segmentation with the highest summed log score. As no piece has a
space after another character, the best path of a text is that of its words, so that every distinct word is searched
once and kept by its worker. A space is written as the marker and one is put before the text; characters that no piece
has, and literal markers, become the pieces of their UTF-8 bytes, so that decoding always gives the text back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cairnfield.llm.pieces import MARK, Trie, Vocabulary, best_paths, build_trie, lattice, read_vocabulary
from cairnfield.llm.words import KeyCache, chunks, id_lists, span_hashes, text_buffer

IDS = "piece_ids"
BLOCK_WORDS = 8_192  # words whose segmentations are searched at once
UNKNOWN_PENALTY = 10.0  # an unknown character scores this much below the rarest piece


def rank_scores(vocabulary: Vocabulary) -> np.ndarray:
    """Log scores by Zipf's law from the order of the pieces in the file, which is by falling frequency."""
    scores = np.full(len(vocabulary.pieces), -np.inf)
    ranks = np.arange(1, len(vocabulary.normal) + 1)
    scores[vocabulary.normal] = -np.log(ranks) - np.log((1 / ranks).sum())
    return scores


def piece_trie(vocabulary: Vocabulary) -> Trie:
    """The trie over pieces with plain spaces for markers; values are piece ids."""
    return build_trie([vocabulary.pieces[i].replace(MARK, " ").encode() for i in vocabulary.normal], vocabulary.normal.tolist())


class PieceModel:
    """Everything a task needs, made once on the driver from one vocabulary file and broadcast (a few MB)."""

    def __init__(self, path: str, scores: np.ndarray | None = None):
        with open(path, "rb") as f:
            self.vocabulary = read_vocabulary(f.read())
        self.scores = rank_scores(self.vocabulary) if scores is None else scores
        self.unknown = float(self.scores[self.vocabulary.normal].min() - UNKNOWN_PENALTY)
        self.trie = piece_trie(self.vocabulary)
        if any(" " in self.vocabulary.pieces[i].replace(MARK, " ").lstrip(" ") for i in self.vocabulary.normal):
            raise ValueError("a piece has a space after another character; words cannot be encoded apart")
        self.newline_alone = not any("\n" in self.vocabulary.pieces[i] for i in self.vocabulary.normal)

    def marked_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with a space before each text, starts and ends of words, and the first word of each text."""
        raw, offsets = text_buffer(texts)
        filled = np.diff(offsets) > 0
        data = np.insert(raw, offsets[:-1][filled], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        if not len(data):
            return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        if self.newline_alone:
            line = data == 10
            start |= line
            start[1:] |= line[:-1]
        start[offsets[:-1][filled]] = True
        starts = np.flatnonzero(start)
        return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of each word, one word after the other, and their offsets."""
        lat = lattice(self.trie, data, starts, ends)
        path, cuts = best_paths(lat, self.scores, self.unknown)
        piece = lat.piece[path].astype(np.int64)
        size = np.where(piece >= 0, 1, lat.end[path] - lat.start[path])
        word = np.repeat(np.arange(len(starts)), np.diff(cuts))
        ids = np.repeat(piece, size)
        within = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        odd = np.flatnonzero(ids < 0)
        at = np.repeat(lat.start[path] - word, size)[odd] + within[odd]
        ids[odd] = self.vocabulary.byte_ids[lat.text[at]]
        return ids, np.concatenate([[0], np.cumsum(size)])[cuts]


class WordEncoder:
    """Encodes texts word by word and remembers the pieces of words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.cache = KeyCache(2, np.int64, 300_000)
        self.pool = np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and their offsets."""
        data, starts, ends, first = self.model.marked_words(texts)
        keys, where, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at, known = self.cache.find(keys)
        place = np.zeros((len(keys), 2), np.int64)  # of the ids of each word in the pool, and their count
        place[known] = self.cache.rows[at[known]]
        new, pool = np.flatnonzero(~known), self.pool
        if len(new):
            parts, size = [pool], len(pool)
            for some in np.array_split(new, -(-len(new) // BLOCK_WORDS)):
                ids, cuts = self.model.encode_words(data, starts[where[some]], ends[where[some]])
                place[some] = np.column_stack([cuts[:-1] + size, np.diff(cuts)])
                parts.append(ids.astype(np.int32))
                size += len(ids)
            pool = np.concatenate(parts)
            if self.cache.add(keys[new], place[new]):
                self.pool = pool
        from_, count = place[back].T
        total = np.cumsum(count)
        ids = pool[np.repeat(from_ - (total - count), count) + np.arange(int(count.sum()))]
        return ids, np.concatenate([[0], total])[first]


_encoders: dict[int, WordEncoder] = {}


def _encoder(model: Broadcast) -> WordEncoder:
    if model.value.token not in _encoders:
        _encoders.clear()
        _encoders[model.value.token] = WordEncoder(model.value)
    return _encoders[model.value.token]


def broadcast_model(spark: SparkSession, path: str, scores: np.ndarray | None = None) -> Broadcast:
    model = PieceModel(path, scores)
    model.token = hash((path, model.scores.tobytes()))
    return spark.sparkContext.broadcast(model)


def _fields(df: DataFrame, keep: Sequence[str], *new: T.StructField) -> T.StructType:
    clash = {f.name for f in new} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    return T.StructType([df.schema[c] for c in keep] + list(new))


class PieceDecoder:
    """Bytes of each piece, to be put together again."""

    def __init__(self, vocabulary: Vocabulary):
        table = [b""] * (len(vocabulary.pieces) + 1)  # the last one stands for ids that aren't in the vocabulary
        for i in vocabulary.normal:
            table[i] = vocabulary.pieces[i].replace(MARK, " ").encode()
        for b, i in enumerate(vocabulary.byte_ids):
            if i >= 0:
                table[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(x) for x in table])
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts and their offsets; the first space of each text goes."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, len(self.size) - 1)
        sizes = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        data = self.flat[np.repeat(self.start[ids] - upto[:-1], sizes) + np.arange(int(upto[-1]))]
        cuts = upto[offsets]
        filled = cuts[:-1] < cuts[1:]
        first = cuts[:-1][filled]
        marked = data[first] == 32
        gone = np.zeros(len(filled), np.int64)
        gone[filled] = marked
        return np.delete(data, first[marked]), cuts - np.concatenate([[0], np.cumsum(gone)])


def encode(
    df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), model: Broadcast | None = None, check: bool = False
) -> DataFrame:
    """Columns ``keep`` and ``piece_ids`` (array of int) of every row.

    Null and empty texts give an empty array; rows are neither joined nor dropped, so repeated rows and ties stay.
    Columns other than ``keep`` aren't read; a kept column with the name of a result is an error. With ``check``,
    ``same_text`` tells whether decoding gives the text (a null one as empty) back.
    """
    model = model or broadcast_model(df.sparkSession, path)
    more = [T.StructField("same_text", T.BooleanType(), False)] if check else []
    schema = _fields(df, keep, T.StructField(IDS, T.ArrayType(T.IntegerType()), False), *more)
    keep = list(keep)
    reads = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(model)
        decoder = PieceDecoder(model.value.vocabulary)
        for whole in batches:
            for batch in chunks(whole, text):
                ids, offsets = coder.encode(batch.column(text))
                out = [*(batch.column(c) for c in keep), id_lists(ids, offsets, pa.int32())]
                if check:
                    out.append(pa.array(_equal(text_buffer(batch.column(text)), decoder.decode(ids, offsets))))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.select(*reads).mapInArrow(run, schema)


def _equal(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the texts of two buffers are the same, one by one."""
    (a, cuts), (b, other) = one, two
    if np.array_equal(cuts, other):
        wrong = np.concatenate([[0], np.cumsum(a != b)])
        return wrong[cuts[1:]] == wrong[cuts[:-1]]
    return np.array([np.array_equal(a[cuts[i] : cuts[i + 1]], b[other[i] : other[i + 1]]) for i in range(len(cuts) - 1)], bool)


def decode(df: DataFrame, path: str, ids: str = IDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the text of the pieces.

    Byte pieces are joined as UTF-8 (broken sequences become U+FFFD), markers become spaces, the first of which goes.
    Null arrays give a null text, empty ones an empty text, ids outside the vocabulary and null ids nothing.
    """
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(PieceDecoder(read_vocabulary(f.read())))
    schema = _fields(df, keep, T.StructField("decoded", T.StringType()))
    keep = list(keep)
    reads = list(dict.fromkeys([*keep, ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = pa.compute.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
            data, cuts = shared.value.decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
            raw, missing = data.tobytes(), column.is_null().to_pylist()
            texts = [None if none else raw[a:b].decode("utf-8", "replace") for none, a, b in zip(missing, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=schema.names)

    return df.select(*reads).mapInArrow(run, schema)
