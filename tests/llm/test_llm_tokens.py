"""Pieces, languages, packing, token counts and secrets against the libraries and plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer, pre_tokenizers

from cairnfield.llm import langid, packing, secrets, sentencepieces, token_counts
from cairnfield.llm.pieces import build_trie, lattice, total_scores

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "   a", "\n\n", "a\tb", "▁x ▁", "é漢☃", "😀 " * 3, "x" * 5000, "don't 'tis 's", "<|endoftext|> a<|endoftext|>", "1 2  3\r\n", "  ", "́a", "a b " * 20_000]


@pytest.fixture(scope="module")
def model(spark):
    return sentencepieces.broadcast_model(spark, PIECES)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    return [(r[0], r[1]) for r in rows] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_003, ODD[3])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'c' as k", "'c' as t", "'c' as piece_count")


def test_trie_and_sums():
    words = [b"a", b"ab", b"abc", b"b", b"bc", b"ca"]
    trie = build_trie(words, range(len(words)))
    rng = np.random.default_rng(1)
    probs, unknown = np.log(rng.uniform(0.01, 0.3, (len(words), 2))), np.array([-3.0, -4.0])
    texts = [b"abcab", b"a", b"xab", b"", b"cc"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    found = total_scores(lattice(trie, data, ends - [len(t) for t in texts], ends), probs, unknown)

    def brute(t, lang):
        if not t:
            return 1.0
        here = sum(np.exp(probs[i, lang]) * brute(t[len(w) :], lang) for i, w in enumerate(words) if t.startswith(w))
        return here if t[:1] in words else here + np.exp(unknown[lang]) * brute(t[1:], lang)

    expected = [[np.log(brute(t, lang)) for lang in (0, 1)] for t in texts]
    assert np.allclose(found, expected)


def test_pieces_against_the_library(spark, docs, texts, model):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # unigram
    scores = model.value.scores
    for i, p in enumerate(proto.pieces):
        p.score = scores[i] if np.isfinite(scores[i]) else 0
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rows = sentencepieces.encode(docs, PIECES, keep=["doc_id", "text", "k"], model=model, check=True).collect()
    assert len(rows) == len(texts) and all(r.same_text for r in rows)
    cost = np.where(np.isfinite(scores), scores, model.value.unknown)
    total = lambda ids: cost[np.array(ids, int)].sum()
    for r in rows:
        if r.text and "▁" not in r.text and len(r.text) < 50_000:
            theirs = library.encode(r.text)
            assert r.piece_ids == theirs or abs(total(r.piece_ids) - total(theirs)) <= 2e-3 * max(1, abs(total(theirs)) / 1000)
    with pytest.raises(ValueError):
        sentencepieces.encode(docs.withColumn("piece_ids", F.lit(1)), PIECES, keep=["piece_ids"], model=model)


def test_decoding(spark, docs, texts, model):
    coded = sentencepieces.encode(docs, PIECES, model=model)
    back = sentencepieces.decode(coded, PIECES).collect()
    assert sorted((r[0], r[1]) for r in back) == sorted((i, t or "") for i, t in texts)
    raw = spark.createDataFrame([(1, None), (2, []), (3, [3 + 0xC3]), (4, [999_999, None, 3 + 65])], "doc_id long, piece_ids array<int>")
    assert {r[0]: r[1] for r in sentencepieces.decode(raw, PIECES).collect()} == {1: None, 2: "", 3: "�", 4: "A"}
    assert sentencepieces.decode(sentencepieces.encode(docs.limit(0), PIECES, model=model), PIECES).collect() == []


def test_language(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    names, probs = langid.learn(docs.filter(~out), PIECES, model=model)
    assert names == sorted({r[0] for r in docs.select("lang").distinct().collect() if r[0]})
    found = langid.predict(docs, PIECES, names, probs, model=model, keep=["lang"]).filter(out).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) > 20
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 3!"), (4, "漢字"), (5, "the and of"), (5, "the and of"), (6, "THE AND OF " * 9000)], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in langid.predict(odd, PIECES, names, probs, model=model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] in names and got[5][0] == got[6][0] == "en"
    assert langid.predict(odd.limit(0), PIECES, names, probs, model=model).collect() == []
    none, empty = langid.learn(docs.limit(0), PIECES, model=model)
    assert none == [] and {r[1] for r in langid.predict(odd, PIECES, none, empty, model=model).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.predict(docs.withColumn("score", F.lit(1)), PIECES, names, probs, model=model, keep=["score"])


def test_token_counts(spark, docs, texts):
    library = Tokenizer.from_file(BPE)
    expected = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    for table in (0, 50, token_counts.TABLE_SIZE):
        assert sorted(map(tuple, token_counts.count_tokens(docs, BPE, table_size=table or 1).collect())) == expected
    assert token_counts.count_tokens(docs.limit(0), BPE).collect() == []


def test_pre_tokens():
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t'sStremvld9a!é ") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    chars, offsets = token_counts._chars(pa.array(texts))
    expected = [offsets[i] + x[1][0] for i, t in enumerate(texts) for x in cut.pre_tokenize_str(t)]
    assert token_counts.pre_tokens(chars, offsets).tolist() == expected


def test_packing(spark, docs, texts):
    library = Tokenizer.from_file(BPE)
    unique = docs.dropDuplicates(["doc_id"])
    packed = packing.pack_tokens(unique, BPE, row_tokens=256, block_rows=8)
    used = 0
    for r in packed.collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(places) == 256 and len(r["keys"]) == len(r.parts) == len(r.cu_seqlens) - 1
        ends = [*r.cu_seqlens, 256]
        assert places.tolist() == [i for a, b in zip(ends[:-1], ends[1:]) for i in range(b - a)]
        used += r.cu_seqlens[-1]
    back = {r[0]: r[1] for r in packing.unpack_tokens(packed).collect()}
    assert back == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    assert used == sum(len(v) + 1 for v in back.values())
    assert packing.pack_tokens(docs.limit(0), BPE).collect() == []


def test_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 51, rng.integers(0, 60))
        rooms, expected = [], []
        for piece in np.argsort(-sizes, kind="stable"):
            fits = [r for r in rooms if r >= sizes[piece]]
            best = min(fits, default=50)
            if fits:
                rooms.remove(best)
            rooms.append(best - int(sizes[piece]))
        found = packing.best_fit_decreasing(sizes, 50)
        assert sorted(i for row in found for i in row) == list(range(len(sizes)))
        expected = sorted(rooms)
        assert sorted(50 - int(sizes[row].sum()) for row in found) == expected


ASSIGN = re.compile(
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def test_secrets(spark):
    rng = random.Random(1)
    parts = "password passwd secret TOKEN Token api_key apikey ſecret api = : \" ' abc AKIA 0123456789abcdef deadbeef Z é \n xyz123 ghp_ xoxb- -----BEGIN".split(" ") + [" ", "PRIVATE KEY-----"]
    texts = [None, "", "AKIA" + "Z" * 90_000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as secrets")
    base = {"assign": 0, "access": 1, "hex": 2}
    for r in secrets.find_secrets(df).collect():
        t = texts[r[0]] or ""
        spans = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        found = [tuple(s) for s in r[1]]
        assert [s for s in found if s[0] in base] == sorted(spans, key=lambda s: (s[1], base[s[0]]))
        assert found == sorted(found, key=lambda s: s[1]) or found == sorted(found, key=lambda s: (s[1], [x.kind for x in secrets.RULES].index(s[0])))
    assert secrets.find_secrets(df.limit(0)).collect() == []


def test_more_secret_kinds():
    text = "ghp_" + "a1B2" * 9 + " xoxb-123456-abcdef eyJhbGci.eyJzdWIi.c2ln -----BEGIN RSA PRIVATE KEY----- ghp_short"
    kinds = [k for k, _, _ in secrets.Scanner().scan(text.encode())]
    assert sorted(kinds) == ["github", "jwt", "private_key", "slack"]
