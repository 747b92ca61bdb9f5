"""Token counts of a byte-level BPE tokenizer without a shuffle of pre-tokens.

Texts are cut into pre-tokens as arrays of characters. Token counts of frequent pre-tokens come from a compact table
that is broadcast; the rest are encoded once by the library and remembered by their worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import PreTokenizer

from cairnfield.llm.words import KeyCache, chunks, span_hashes, text_buffer
from cairnfield.llm.work import refuse_clashes

TABLE_SIZE = 65_536  # pre-tokens in the broadcast table: 12 bytes each
SAMPLE_DOCS = 4_000  # expected rows from which the table is chosen; it only decides which counts are ready-made
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
LAST_PLAIN = 0x024F  # up to here the classes of characters are the same in every Unicode version


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each character up to ``LAST_PLAIN`` as the pattern of the tokenizer has them."""
    kinds = np.full(LAST_PLAIN + 1, OTHER, np.uint8)
    for c in range(LAST_PLAIN + 1):
        if regex.match(r"\p{L}", chr(c)):
            kinds[c] = LETTER
        elif regex.match(r"\p{N}", chr(c)):
            kinds[c] = NUMBER
        elif regex.match(r"\p{White_Space}", chr(c)):
            kinds[c] = SPACE
    return kinds


@lru_cache(maxsize=1)
def _all_classes() -> np.ndarray:
    """Class of every character; UNKNOWN above ``LAST_PLAIN`` until :func:`_learn_classes` meets it."""
    kinds = np.full(0x110000, UNKNOWN, np.uint8)
    kinds[: LAST_PLAIN + 1] = _classes()
    return kinds


def _learn_classes(chars: np.ndarray, cutter: PreTokenizer) -> np.ndarray:
    """Classes with those of all ``chars``: the library's own, told by which neighbours a character isn't cut from."""
    kinds = _all_classes()
    for c in np.unique(chars[kinds[chars] == UNKNOWN]).tolist():
        alike = [kind for kind, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cutter.pre_tokenize_str(x + chr(c) + x)) == 1]
        kinds[c] = alike[0] if alike else SPACE
    return kinds


def pre_tokens(chars: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Starts of all pre-tokens; ``chars`` are the code points of all texts, cut at ``offsets``.

    ``kinds`` has the classes of characters; by default it has those up to ``LAST_PLAIN``.

    A pre-token is a run of letters, of digits or of other signs, each with one plain space before it if there is one;
    an apostrophe with s, t, m, d, re, ve or ll after it; or white space up to the character before such a run.
    """
    n = len(chars)
    kind = (_classes() if kinds is None else kinds)[chars]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    run = border[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    space = kind == SPACE
    # The last of several white spaces before something else stands by itself or goes with what follows.
    before_solid = np.zeros(n, bool)
    before_solid[:-1] = space[:-1] & ~space[1:] & ~border[1:n]
    start |= before_solid
    joined = np.zeros(n, bool)  # has a plain space before it that belongs to it
    joined[1:] = before_solid[:-1] & (chars[:-1] == 32)
    start &= ~joined
    # Contractions: an apostrophe that starts a pre-token and is a run by itself, with one of the endings.
    quote = np.flatnonzero((chars == 39) & start)
    if len(quote):
        padded = np.append(chars, [0, 0, 0])
        limit = offsets[np.searchsorted(offsets, quote, side="right")]
        a, b = np.where(quote + 1 < limit, padded[quote + 1], 0), np.where(quote + 2 < limit, padded[quote + 2], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            start[q + 1] = False
            after = q + 1 + size
            inside = after < limit[hit]
            start[after[inside]] = True
    return np.flatnonzero(start)


def _chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of each."""
    raw, offsets = text_buffer(texts)
    chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return chars, first[offsets]


def _plain(texts: pa.Array, specials: list[str]) -> np.ndarray:
    """Texts without special tokens, and with characters whose class no Unicode version changes."""
    chars, offsets = _chars(texts)
    odd = np.concatenate([[0], np.cumsum(chars > LAST_PLAIN)])
    return _without(texts, specials) & (odd[offsets[1:]] == odd[offsets[:-1]])


def _without(texts: pa.Array, specials: list[str]) -> np.ndarray:
    """Texts without special tokens."""
    good = np.ones(len(texts), bool)
    for s in specials:
        good &= ~pa.compute.fill_null(pa.compute.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
    return good


def _keyed(texts: pa.Array, cutter: PreTokenizer | None = None):
    """Keys of all distinct pre-tokens, where each first stands, which one each is, and the first of each text.

    Without the library's ``cutter`` there must be no character above ``LAST_PLAIN``.
    """
    chars, offsets = _chars(texts)
    if not len(chars):
        return np.zeros(0, np.uint64), chars, np.zeros((0, 2), int), np.zeros(0, int), np.zeros(len(offsets), int)
    starts = pre_tokens(chars, offsets, _learn_classes(chars, cutter) if cutter else None)
    ends = np.append(starts[1:], len(chars))
    # Pre-tokens are hashed as bytes of UTF-8.
    raw = text_buffer(texts)[0]
    at = np.flatnonzero((raw & 0xC0) != 0x80)[starts]
    keys, where, back = np.unique(span_hashes(raw, at, np.append(at[1:], len(raw))), return_index=True, return_inverse=True)
    return keys, chars, np.column_stack([starts[where], ends[where]]), back, np.searchsorted(starts, offsets)


def _string(chars: np.ndarray, span: np.ndarray) -> str:
    return chars[span[0] : span[1]].tobytes().decode("utf-32-le")


def _load(blob: bytes) -> Tokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_buffer(blob)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _lengths(tokenizer: Tokenizer, strings: list[str]) -> np.ndarray:
    return np.array([len(e.ids) for e in tokenizer.encode_batch(strings, add_special_tokens=False)], np.int64)


def frequent_table(df: DataFrame, blob: bytes, text: str = "text", size: int = TABLE_SIZE, sample_docs: int = SAMPLE_DOCS):
    """Keys (sorted) and token counts of the most frequent pre-tokens of a sample of about ``sample_docs`` rows.

    Each task hands over at most ``size`` pre-tokens, and at most ``size`` are fetched.
    """
    cutter = _load(blob).pre_tokenizer
    rows = df.count()
    share = min(1.0, sample_docs / max(rows, 1))
    draw = F.pmod(F.xxhash64(F.lit("table"), F.col(text)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for whole in batches:
            for batch in chunks(whole, "t"):
                _, chars, spans, back, _ = _keyed(batch.column("t"), cutter)
                for span, n in zip(spans, np.bincount(back, minlength=len(spans)).tolist(), strict=True):
                    word = _string(chars, span)
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > 8 * size:
                    counts = dict(sorted(counts.items(), key=lambda x: -x[1])[:size])
        top = sorted(counts.items(), key=lambda x: -x[1])[:size]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["w", "n"])

    sample = df.select(F.col(text).alias("t")).filter(F.col("t").isNotNull() & (draw < share))
    top = sample.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    words = top.toArrow().column("w").to_pylist()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    keys = span_hashes(flat, np.concatenate([[0], ends[:-1]]), ends)
    order = np.argsort(keys)
    return keys[order], _lengths(_load(blob), words)[order]


_workers: dict[int, tuple] = {}


def count_tokens(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", table_size: int = TABLE_SIZE, sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """Columns ``key``, ``n_bytes`` (of UTF-8) and ``n_tokens`` of every row, as the tokenizer file gives them.

    A null text counts as empty: 0 and 0. No tokens are added at the ends; special tokens inside a text count as one,
    as is the library's default. Only the key and the text are read; repeated rows give repeated results. A key named as
    a result is an error.
    """
    refuse_clashes(key, "n_bytes", "n_tokens")
    with open(path, "rb") as f:
        blob = f.read()
    spark = df.sparkSession
    specials = [t.content for t in _load(blob).get_added_tokens_decoder().values()]
    keys, sizes = frequent_table(df, blob, text, table_size, sample_docs)
    shared = spark.sparkContext.broadcast((blob, keys, sizes.astype(np.int32), hash((blob, keys.tobytes()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, known_keys, known_sizes, token = shared.value
        if token not in _workers:
            _workers.clear()
            _workers[token] = (_load(source), KeyCache(1, np.int64))
        tokenizer, cache = _workers[token]
        for whole in batches:
            for batch in chunks(whole, "t"):
                texts = batch.column("t").fill_null("")
                plain = _without(texts, specials)
                n_tokens = np.zeros(len(texts), np.int64)
                cut_here = texts.filter(pa.array(plain))
                distinct, chars, spans, back, first = _keyed(cut_here, tokenizer.pre_tokenizer)
                sizes_here = np.zeros(len(distinct), np.int64)
                missing = np.ones(len(distinct), bool)
                if len(known_keys):
                    at = np.minimum(np.searchsorted(known_keys, distinct), len(known_keys) - 1)
                    missing = known_keys[at] != distinct
                    sizes_here[~missing] = known_sizes[at[~missing]]
                at, cached = cache.find(distinct)
                cached &= missing
                sizes_here[cached] = cache.rows[at[cached], 0]
                new = np.flatnonzero(missing & ~cached)
                if len(new):
                    sizes_here[new] = _lengths(tokenizer, [_string(chars, s) for s in spans[new]])
                    cache.add(distinct[new], sizes_here[new, None])
                total = np.concatenate([[0], np.cumsum(sizes_here[back])])
                n_tokens[plain] = total[first[1:]] - total[first[:-1]]
                for i in np.flatnonzero(~plain):
                    n_tokens[i] = len(tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids)
                n_bytes = np.diff(text_buffer(texts)[1])
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n_bytes), pa.array(n_tokens)], names=[key, "n_bytes", "n_tokens"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)
