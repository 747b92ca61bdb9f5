"""Words, shingles, decontamination, shingle sets and lines against plain Python."""

import random
import re

import pyarrow as pa
import pytest

from cairnfield.llm import decontaminate, linededup, setjoin
from cairnfield.llm.words import chunks, distinct_per_text, find_words, shingle_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "k string, t string, d long, id long, n long, rep long, component_id long, line string, first long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t, size=5):
    w = WORD.findall(lower(t or ""))
    if 0 < len(w) < size:
        return {" ".join(w)}
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def with_clashes(df):
    """The same rows with extra columns whose names the operators use inside."""
    taken = set(df.columns)
    return df.selectExpr("*", *[f"cast(null as {t}) as {n}" for n, t in (c.split() for c in CLASH.split(", ")) if n not in taken])


def random_text(rng, words, n):
    return rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(n))


def test_words_and_shingles():
    rng = random.Random(1)
    texts = [None, "", "   ", "a", "A\tb\x0bc", "Éa é", "x y z u v w"] + [random_text(rng, ["a", "B", "çé", "日本"], rng.randint(0, 12)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    seen, count = {}, 0
    for part in chunks(batch, "t", 40):
        words = find_words(part.column("t"))
        found = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
        assert found == [w for t in part.column("t").to_pylist() for w in WORD.findall(lower(t or ""))]
        hashes, cuts = distinct_per_text(*shingle_hashes(words), part.num_rows)
        for i, t in enumerate(part.column("t").to_pylist()):
            assert cuts[i + 1] - cuts[i] == len(shingles(t))
            seen.setdefault(frozenset(shingles(t)), set()).add(tuple(hashes[cuts[i] : cuts[i + 1]].tolist()))
        count += part.num_rows
    assert count == len(texts) and all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    items = [(i, random_text(rng, words, n)) for i, n in enumerate([1, 3, 4, 5, 6, 9, 15, 20, 33, 60, 60, 120])] + [(20, None), (21, ""), (22, "  "), (7, "w1 w2")]
    docs = [(i, random_text(rng, words, rng.choice([0, 3, 50, 400]))) for i in range(40)] + [(100, None), (101, "")]
    for i in range(40, 70):
        a, b = rng.choice(items[3:12])[1], random_text(rng, words, 200)
        if i % 3 == 0:
            a = " ".join(a.split()[: rng.randint(3, 60)])
        if i % 5 == 0:
            a = a.upper()
        docs.append((i, b + "\n" + a + " " + b))
    docs += [(70, items[1][1]), (71, items[4][1]), (71, items[4][1]), (72, "x " * 30_000 + items[9][1] + " y" * 30_000)]
    expected = []
    for d, t in docs:
        for i, q in items:
            wanted, mine = shingles(q), shingles(t)
            if wanted and 100 * len(wanted & mine) >= 80 * len(wanted):
                expected.append((d, i, len(wanted), len(wanted & mine)))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(expected) > 20
    assert sorted(map(tuple, decontaminate.find_leaks(with_clashes(d), q).collect())) == sorted(expected)
    assert sorted(map(tuple, decontaminate.find_leaks(d, q, block=4).collect())) == sorted(expected)
    assert decontaminate.find_leaks(d, q.limit(0)).collect() == [] and decontaminate.find_leaks(d.limit(0), q).collect() == []


def test_jaccard_components(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FREQUENT_SHARE", 0.02)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    docs = [(100 + i, random_text(rng, words, rng.choice([0, 2, 4, 5, 30, 90]))) for i in range(20)] + [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a\nB")]
    common = random_text(rng, words, 40)
    for g in range(4):  # groups of near copies, and one passage in many documents
        base = random_text(rng, words, 120).split()
        for k in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = "new"
            docs.append((1000 + 100 * g + k, " ".join(copy)))
        docs.append((2000 + g, " ".join(base[:60]) + " " + common))
    docs += [(3000 + i, common + " " + random_text(rng, words, 25)) for i in range(30)]
    rng.shuffle(docs)
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    labels = groups(links, ids)
    df = spark.createDataFrame(docs + [(None, "a b")], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in setjoin.jaccard_components(with_clashes(df)).collect()}
    assert got.pop(None) == (1, None)
    assert got == {d: (len(sets[d]), labels[d]) for d in ids}
    assert setjoin.jaccard_components(df.limit(0)).collect() == []


def test_lines(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 30))) for _ in range(10)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        return "".join(s)

    tail = [[], ["x"], ["", " \t"], ["x", "x"]]
    docs = [(i, "\n".join([changed(rng.choice(base)) for _ in range(4)] + rng.choice(tail))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "x"), (103, "long " * 20_000 + "\n" + "long " * 20_000), (None, "x\nx")]
    seen, expected = [], {}
    for i, t in docs:
        kept = []
        for line in t.split("\n") if t is not None else []:
            if line.strip(" \t\r"):
                near = (m for m in seen if len(line) < 1000 and min(len(line), len(m)) >= 20 and abs(len(line) - len(m)) <= 2)
                repeated = i is not None and (line in seen or any(edits(line, m) <= 2 for m in near))
                seen.append(line)
                if repeated:
                    continue
            kept.append(line)
        n = len(t.split("\n")) if t is not None else 0
        expected[i] = (None if t is None else "\n".join(kept), n, n - len(kept))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(with_clashes(df), keep=["k", "line"]).collect()}
    assert got == expected
    assert linededup.dedup_lines(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        linededup.dedup_lines(df, keep=["text"])


def test_edit_bits(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        x = "".join(rng.choice("ab") for _ in range(rng.randint(3, 9)))
        y = "".join(rng.choice("ab") for _ in range(rng.randint(1, len(x))))
        pairs.append((x, y))
    df = spark.createDataFrame(pairs, "x string, y string")
    for most in (1, 2, 3):
        found = df.select("x", "y", linededup.within(df.x, df.y, most).alias("ok")).collect()
        assert all(r.ok == (edits(r.x, r.y) <= most) for r in found)


def test_line_plan_has_no_python(spark, sf):
    df = linededup.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
