"""Spelling variants against brute force, and the bound of affected grams against all edits."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from cairnfield.llm import spelling
from cairnfield.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def misspelled(docs):
    count = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def edits_of(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def grouped(count):
    letters = {c for w in count for c in w}
    near = {w: [x for x in edits_of(w, letters) if x in count] for w in count}
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None)
    return out


def random_docs(rng, n):
    syllables = ["the", "an", "ion", "é", "ré", "ou", "er", "ch", "st", "ü", "in", "ent"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    for _ in range(300):
        w = rng.choice(words)
        words.append(rng.choice(sorted(edits_of(w, "abé"))))
    return [(i, rng.choice([" ", "-", "\n", "×", "1"]).join(rng.choice([w, w.title(), w.upper()]) for w in rng.choices(words, k=rng.randint(0, 300)))) for i in range(n)]


def test_words_and_variants_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    docs = [*random_docs(rng, 120), (500, None), (501, ""), (None, "abcdef " * 4), (502, "漢字 12 ĀbcdeĀ"), *[(503 + i, "z" * 69_999 + " " + "z" * 70_000) for i in range(5)]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "2 as k", "3 as t", "4 as gram")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    count = misspelled(docs)
    assert len(count) > 300 and any(len(w) > 60_000 for w in count)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()}
    long = {w for w in count if len(w) > 60_000}
    assert {(len(w), got[w][3]) for w in long} == {(69_999, 1), (70_000, 1)}
    want = grouped({w: n for w, n in count.items() if w not in long})
    assert {w: x for w, x in got.items() if w not in long} == want and set(got) == set(count)
    assert any(f for f, *_ in want.values()) and any(want[f][0] for f, *_ in want.values() if f)


def test_chains_ties_and_empty(spark):
    rows = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("bbbbb", 200), ("xaaaa", 6), ("other", 9), (None, 4), ("lonely", None), ("seldom", 2)]
    frame = spark.createDataFrame(rows, "word string, n long").selectExpr("*", "1 as form", "2 as gram", "3 as size")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.group_variants(frame).collect()}
    assert got["aaaaa"] == ("aaaab", "bbbbb", 2) and got["bbbbb"] == (None, "bbbbb", 1) and got["other"] == (None, "other", 0)
    assert set(got) == {r[0] for r in rows[:8]}
    assert spelling.group_variants(frame.limit(0)).collect() == []
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.misspelled_words(none).collect() == []


@pytest.mark.parametrize("least", [0, 1, 3, 8])
def test_no_edit_affects_more_grams_than_bounded(least):
    rng = random.Random(least)
    words = {"".join(rng.choice("ab") if rng.random() < 0.8 else rng.choice("cd") for _ in range(rng.randint(4, 11))) for _ in range(150)}
    freq = Counter(w[i : i + q] for w in words for q in range(spelling.SHORTEST, spelling.LONGEST) for i in range(len(w) - q + 1))
    cuts = spelling.GramDictionary({g: n for g, n in freq.items() if n > least})
    for w in words:
        grams = cuts.cut(w)
        bound = cuts.affected(w, grams)
        for x in edits_of(w, "abcd"):
            if len(x) < spelling.SHORTEST:
                continue
            theirs = set(cuts.cut(x))
            shift = len(x) - len(w)
            shared = sum(1 for p, g in grams if (p, g) in theirs or (p + shift, g) in theirs)
            assert shared >= len(grams) - bound, (w, x)


def test_near_words_share_one_of_their_rarest_grams():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice(["an", "the", "r", "st"]) for _ in range(rng.randint(3, 5))) for _ in range(300)})
    freq = Counter(w[i : i + q] for w in words for q in range(spelling.SHORTEST, spelling.LONGEST) for i in range(len(w) - q + 1))
    cuts = spelling.GramDictionary({g: n for g, n in freq.items() if n > 5})
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and b in edits_of(a, "antherts"):
            (x, enough_x), (y, enough_y) = cuts.rarest(a), cuts.rarest(b)
            if enough_x or enough_y:
                assert {g for _, g in x} & {g for _, g in y}, (a, b)


def test_words_without_a_safe_gram_meet_words_with_one(spark):
    rng = random.Random(0)
    words = {"".join(rng.choice("aé") for _ in range(rng.choice([5, 6, 7, 8, 10]))) for _ in range(60)}
    words |= {x for w in sorted(words) for x in rng.sample(sorted(edits_of(w, "aé")), 3) if len(x) >= 5}
    count = {w: rng.randint(1, 40) for w in sorted(words)}
    known = spark.createDataFrame(sorted(count.items()), "word string, n long")
    cuts = spelling.gram_dictionary(known)
    enough = {w: cuts.rarest(w)[1] for w in words}
    assert any(enough[w] and not enough[x] for w in words for x in edits_of(w, "aé") & words)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(known, min_n=1).collect()}
    assert got == grouped(count)
