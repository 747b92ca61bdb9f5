"""Katz backoff against the same model in plain Python, and its sums of probabilities."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cairnfield.llm import katz
from cairnfield.llm.queries import QUERIES
from cairnfield.llm.words import find_words

K = katz.DISCOUNTED


def tokens(text):
    return [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))] + [None]


def discounts(counts):
    n = Counter(counts)
    out = {}
    rest = (K + 1) * n[K + 1] / n[1] if n[1] else 1
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if n[r] and rest < 1 else 1
        out[r] = d if 0 < d <= 1 else 1
    return lambda c: out.get(c, 1)


class Plain:
    def __init__(self, texts, vocabulary, rare):
        self.words = Counter(w for t in texts for w in tokens(t))
        ranked = Counter(n for w, n in self.words.items() if w is not None)
        room, least = vocabulary, math.inf
        for n in sorted(ranked, reverse=True):
            room -= ranked[n]
            if room < 0:
                break
            least = n
        self.rare, self.least = rare, least
        self.n_classes = 1 + sum(1 for w, n in self.words.items() if w is not None and n >= least) + rare
        self.classes, self.types, self.pairs = Counter(), Counter(), Counter()
        for w, n in self.words.items():
            self.classes[self.of(w)] += n
            self.types[self.of(w)] += 1
        for t in texts:
            seq = [self.of(w) for w in [None, *tokens(t)]]
            self.pairs.update(zip(seq, seq[1:], strict=False))
        self.after = defaultdict(dict)
        for (v, w), n in self.pairs.items():
            self.after[v][w] = n
        self.d1, self.d2 = discounts(self.classes.values()), discounts(self.pairs.values())
        self.n = sum(self.words.values())

    def of(self, w):
        if w is None or self.words[w] >= self.least:
            return w
        return int(find_words(pa.array([w])).hashes[0]) % self.rare

    def p1(self, w):
        kept = sum(self.d1(n) * n for n in self.classes.values())
        total = self.n if kept < self.n * (1 - 1e-12) else self.n + 1
        unseen = self.n_classes - len(self.classes)
        if not unseen:
            return self.d1(self.classes[w]) * self.classes[w] / kept
        return self.d1(self.classes[w]) * self.classes[w] / total if w in self.classes else (1 - kept / total) / unseen

    def p2(self, w, v):
        seen = self.after.get(v)
        if not seen:
            return self.p1(w)
        kept, count = sum(self.d2(n) * n for n in seen.values()), self.classes[v]
        total = kept if len(seen) == self.n_classes else count if kept < count * (1 - 1e-12) else count + 1
        if w in seen:
            return self.d2(seen[w]) * seen[w] / total
        return (1 - kept / total) / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def score(self, text):
        total, v = 0.0, None
        for w in tokens(text):
            c = self.of(w)
            total += math.log10(self.p2(c, v))
            if isinstance(c, int):
                total += math.log10((self.words[w] + 0.5) / (self.classes[c] + 0.5 * (self.types[c] + 1)))
            v = c
        return total

    def base(self, text):
        return sum(math.log10((self.words[w] + 0.5) / (self.n + 0.5 * (len(self.words) + 1))) for w in tokens(text))


def corpus(rng, n):
    words = ["The", "a", "Of", "é", "x,", "漢字", *[f"w{i}" for i in range(60)]]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, rng.choice([" ", "\n", "  "]).join(rng.choices(words, weights, k=rng.randint(0, 25)))) for i in range(n)]


@pytest.mark.parametrize(("vocabulary", "rare"), [(1 << 16, 1 << 10), (12, 8), (0, 4)])
def test_scores_equal_plain_python(spark, vocabulary, rare):
    rng = random.Random(vocabulary)
    docs = [*corpus(rng, 150), (900, None), (901, ""), (None, "The a"), (902, "new words a"), (903, "of The " * 3000), (5, "a a"), (904, "same w1 new"), (904, "same w1 new")]
    train = [r for r in docs if (r[0] or 0) % 3]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as k", "3 as h", "4 as score", "5 as c")
    model = katz.fit(frame.filter("coalesce(doc_id, 0) % 3 > 0").repartition(3), vocabulary=vocabulary, rare_classes=rare)
    plain = Plain([t for _, t in train], vocabulary, rare)
    got = sorted(((r.doc_id or -1, r.n_tokens), r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score(frame, model).collect())
    want = sorted(((i or -1, len(tokens(t))), sum(plain.words[w] > 0 for w in tokens(t)), plain.n, plain.base(t), plain.score(t)) for i, t in docs)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-9, atol=1e-9)


def test_probabilities_of_every_context_sum_to_one(spark):
    docs = spark.createDataFrame(corpus(random.Random(2), 200), "doc_id long, text string")
    model = katz.fit(docs, vocabulary=40, rare_classes=16)
    own, size = 10**model.classes.own, len(model.classes.counts)
    assert own.sum() == pytest.approx(1)
    seen = defaultdict(dict)
    for r in model.pairs.collect():
        for code, n in zip(katz._unpack_sorted(r.codes), katz._unpack(r.counts), strict=True):
            seen[int(code) >> katz.SHIFT][int(code) & (1 << katz.SHIFT) - 1] = n
    assert len(seen) > 40
    for v in range(size):
        p = 10 ** model.backoff[v] * own
        for w, n in seen[v].items():
            p[w] = model.discounts[min(n, K + 1)] * n / 10 ** model.divisor[v]
        assert p.sum() == pytest.approx(1)


def test_hot_contexts_and_many_buckets_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(random.Random(4), 120), "doc_id long, text string")
    plain = sorted(map(tuple, katz.score(docs, katz.fit(docs)).collect()))
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 50)
    monkeypatch.setattr(katz, "HOT_CONTEXT", 20)
    model = katz.fit(docs)
    assert model.classes.buckets > 10 and model.pairs.count() > 10
    split = sorted(map(tuple, katz.score(docs, model).collect()))
    assert np.allclose(np.array(plain), np.array(split))


def test_query_and_empty_tables(spark, tmp_path):
    docs = corpus(random.Random(8), 80)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    plain = Plain([t for i, t in docs if not out[i]], katz.VOCABULARY, katz.RARE_CLASSES)
    got = {r.doc_id: r for r in QUERIES["op11_katz_scores"](spark, str(tmp_path)).collect()}
    assert {i: r.held_out for i, r in got.items()} == out and any(out.values())
    for i, t in docs:
        assert got[i].score == pytest.approx(plain.score(t)) and got[i].base_score == pytest.approx(plain.base(t))
    frame = spark.createDataFrame(docs[:3], "doc_id long, text string")
    nothing = katz.fit(frame.limit(0), vocabulary=8, rare_classes=4)
    assert [r.n_known for r in katz.score(frame, nothing).collect()] == [0, 0, 0]
    assert katz.score(frame.limit(0), nothing).collect() == []
    with pytest.raises(ValueError):
        katz.score(frame.withColumnRenamed("doc_id", "score"), nothing, key="score")
