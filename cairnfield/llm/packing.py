"""Fixed-length token rows by best-fit-decreasing packing.

Texts are encoded by a byte-level BPE tokenizer and end with one end-of-text token. A text longer than a row is cut
into rows' worth of tokens and a rest, which loses nothing. Each task packs its pieces in blocks of bounded size: longest
first, each into the row with the least room that still takes it, which a segment tree over room sizes finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.token_counts import _keyed, _load, _plain, _string
from cairnfield.llm.words import KeyCache, chunks

ROW_TOKENS = 2048
BLOCK_ROWS = 2048  # rows' worth of tokens that are packed at once
IDS = np.dtype("<u2")
POSITIONS = np.dtype("<u2")


class BpeEncoder:
    """Token ids of whole texts; those of each distinct pre-token are asked for once and remembered."""

    def __init__(self, blob: bytes):
        self.tokenizer = _load(blob)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = KeyCache(2, np.int64)
        self.pool = np.zeros(0, IDS)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.fill_null("")
        plain = _plain(texts, self.specials)
        keys, chars, spans, back, first = _keyed(texts.filter(pa.array(plain)))
        at, known = self.cache.find(keys)
        place = np.zeros((len(keys), 2), np.int64)
        place[known] = self.cache.rows[at[known]]
        new, pool = np.flatnonzero(~known), self.pool
        if len(new):
            coded = self.tokenizer.encode_batch([_string(chars, s) for s in spans[new]], add_special_tokens=False)
            ids = [c.ids for c in coded]
            sizes = np.array([len(i) for i in ids])
            place[new] = np.column_stack([np.cumsum(sizes) - sizes + len(pool), sizes])
            pool = np.concatenate([pool, np.array([x for i in ids for x in i], IDS)])
            if self.cache.add(keys[new], place[new]):
                self.pool = pool
        start, count = place[back].T if len(back) else np.zeros((2, 0), np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        flat = pool[np.repeat(start - total[:-1], count) + np.arange(int(total[-1]))]
        cuts = total[first]
        out, n = [], 0
        for i, easy in enumerate(plain.tolist()):
            if easy:
                out.append(flat[cuts[n] : cuts[n + 1]])
                n += 1
            else:
                out.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, IDS))
        return out


class RoomTree:
    """Open rows by the room they have left; finds the least room of at least a size in logarithmic time."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Room and number of the fullest row that takes ``size``, which is no longer open then."""
        node = self.leaves + size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(sizes: np.ndarray, row_tokens: int) -> list[list[int]]:
    """Pieces of each row; equal sizes go in the order they came."""
    tree, rows = RoomTree(row_tokens), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        room, row = tree.take(size) or (row_tokens, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(piece)
        if room > size:
            tree.put(room - size, row)
    return rows


def pack_tokens(
    df: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    row_tokens: int = ROW_TOKENS,
    block_rows: int = BLOCK_ROWS,
    end: str = "<|endoftext|>",
) -> DataFrame:
    """One row per packed row of tokens.

    Columns: ``ids`` (binary: ``row_tokens`` 16-bit numbers, low byte first, filled up with the end token),
    ``positions`` (binary, likewise: place in the segment, beginning at 0 in each, also in what fills up), ``cu_seqlens``
    (cumulative segment lengths from 0 on, without what fills up), ``keys`` and ``parts`` of the segments (part: which
    cut of its text, from 0). A null or empty text is one end token. Every row of ``df`` is packed, repeated ones too;
    only the key and the text are read. The vocabulary must have fewer than 65,537 ids and rows fewer than 65,537 tokens.
    """
    with open(path, "rb") as f:
        blob = f.read()
    tokenizer = _load(blob)
    end_id = tokenizer.token_to_id(end)
    if end_id is None or tokenizer.get_vocab_size() > 1 << 16 or not 1 < row_tokens <= 1 << 16:
        raise ValueError("no such end token, or numbers beyond 16 bits")
    shared = df.sparkSession.sparkContext.broadcast(blob)

    def rows_of(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        ids, positions, cuts, keys, parts = [], [], [], [], []
        place = np.arange(row_tokens).astype(POSITIONS)
        for row in best_fit_decreasing(np.array([len(p[2]) for p in pieces]), row_tokens):
            used = [pieces[i] for i in row]
            sizes = [len(p[2]) for p in used]
            fill = row_tokens - sum(sizes)
            ids.append(np.concatenate([*(p[2] for p in used), np.full(fill, end_id, IDS)]).tobytes())
            positions.append(np.concatenate([place[:n] for n in [*sizes, fill]]).tobytes())
            cuts.append([0, *np.cumsum(sizes).tolist()])
            keys.append([p[0] for p in used])
            parts.append([p[1] for p in used])
        arrays = [pa.array(ids, pa.binary()), pa.array(positions, pa.binary()), pa.array(cuts, pa.list_(pa.int32())), pa.array(keys, pa.list_(kind)), pa.array(parts, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "positions", "cu_seqlens", "keys", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value)
        pieces, held, kind = [], 0, None
        for whole in batches:
            for batch in chunks(whole, "t"):
                kind = batch.column("k").type
                for k, ids in zip(batch.column("k").to_pylist(), coder.encode(batch.column("t")), strict=True):
                    ids = np.append(ids, IDS.type(end_id))
                    for part, start in enumerate(range(0, len(ids), row_tokens)):
                        pieces.append((k, part, ids[start : start + row_tokens]))
                        held += len(pieces[-1][2])
                        if held >= row_tokens * block_rows:
                            yield rows_of(pieces, kind)
                            pieces, held = [], 0
        if pieces:
            yield rows_of(pieces, kind)

    integers = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [T.StructField("ids", T.BinaryType()), T.StructField("positions", T.BinaryType()), T.StructField("cu_seqlens", integers)]
        + [T.StructField("keys", T.ArrayType(df.schema[key].dataType)), T.StructField("parts", integers)]
    )
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


_encoders: dict[int, BpeEncoder] = {}


def _encoder(blob: bytes) -> BpeEncoder:
    if hash(blob) not in _encoders:
        _encoders.clear()
        _encoders[hash(blob)] = BpeEncoder(blob)
    return _encoders[hash(blob)]


def unpack_tokens(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Columns ``key`` and ``token_ids`` (array of int, without the end token): every text's tokens, joined from its parts.

    Keys must be distinct. The rows of a text are brought together, so that a row of the result is as long as its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, pieces = [], [], []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], IDS)
                for k, p, a, b in zip(row["keys"], row["parts"], row["cu_seqlens"][:-1], row["cu_seqlens"][1:], strict=True):
                    keys.append(k)
                    parts.append(p)
                    pieces.append(ids[a:b].astype(np.int32))
            kind = batch.schema.field("keys").type.value_type
            arrays = [pa.array(keys, kind), pa.array(parts, pa.int32()), pa.array(pieces, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "part", "ids"])

    kind = packed.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("k", kind), T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    parts = packed.select("ids", "cu_seqlens", "keys", "parts").mapInArrow(run, schema)
    whole = parts.groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("all"))
    return whole.select(F.col("k").alias(key), F.slice("all", 1, F.size("all") - 1).alias("token_ids"))
