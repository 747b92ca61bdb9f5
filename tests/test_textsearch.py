import math

import pytest
from pyspark.sql import functions as F

from cairnfield.functions.text import extension, token_count, tokens
from cairnfield.operators import textsearch as T
from cairnfield.sources.results import export_layers, render_hits

DOCS = [(1, "/a/beach_sunset.png", "The sun sets; the SUN rises"), (2, "/a/office_desk.png", "a desk in the sun"),
        (3, "/b/x.txt", "Émile's café, sun-set at noon"), (4, "/b/empty.txt", ""), (5, "/b/y.txt", "noon desk noon")]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(DOCS, "id long, path string, body string")
    return T.build_postings(T.text_fields(df), "id", ["filename", "body"])


def ids(df):
    return sorted(r.id for r in df.collect())


def test_tokens_and_counts(spark):
    df = spark.createDataFrame([("Émile's café — ÀÉ x2",), ("",), ("...",), ("été Ω",)], "t string")
    got = [(list(r[0]), r[1]) for r in df.select(tokens(F.col("t")), token_count(F.col("t"))).collect()]
    assert got == [(["emile", "s", "cafe", "ae", "x2"], 5), ([], 0), ([], 0), (["ete", "ω"], 2)]


def test_fields(spark):
    df = spark.createDataFrame([("/photos/trip-1/x_y.JPG", " Canon", "EOS  R5")], "path string, make string, model string")
    r = T.text_fields(df, "path", ["make", "model"]).first()
    assert (r.filename, r.text) == ("x y JPG", "photos trip 1 Canon EOS R5")
    names = spark.createDataFrame([("/a/b.TAR.Gz",), ("/a/.hidden",), ("noext",), ("x.",), ("/d.ir/f",)], "p string")
    assert [r[0] for r in names.select(extension(F.col("p"))).collect()] == ["gz", "", "", "", ""]


def test_matching(index):
    assert ids(T.match_text(index, all=["sun", "the"])) == [1, 2]
    assert ids(T.match_text(index, any=["cafe", "desk"])) == [2, 3, 5]
    assert ids(T.match_text(index, any=["sun"], none=["café"])) == [1, 2]
    assert ids(T.match_text(index, phrase="the sun")) == [1, 2]
    assert ids(T.match_text(index, phrase="noon desk noon")) == [5]
    assert ids(T.match_text(index, phrase="noon noon")) == []
    assert ids(T.match_text(index, prefix="Be")) == [1]
    assert ids(T.match_text(index, all=["desk"], field="filename")) == [2]
    with pytest.raises(ValueError):
        T.match_text(index)


def test_rank_formula(index):
    best = T.search_text(index, limit=2, all=["noon"]).collect()
    lengths = {1: 9, 2: 8, 3: 9, 4: 2, 5: 5}
    avg = sum(lengths.values()) / 5
    idf = max(1e-6, math.log((5 - 2 + 0.5) / (2 + 0.5)))

    def score(tf, n):
        return -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))

    assert [r.id for r in best] == [5, 3]
    assert [r["rank"] for r in best] == pytest.approx([score(2, 5), score(1, 9)])


def test_refresh_and_store(spark, index, tmp_path):
    edited = spark.createDataFrame([(5, "/b/y.txt", "zebra")], "id long, path string, body string")
    changed = T.build_postings(T.text_fields(edited), "id", ["filename", "body"])
    after = T.refresh_postings(index, changed, spark.createDataFrame([(2,)], "id long"))
    assert ids(T.match_text(after, any=["desk", "zebra", "noon"])) == [3, 5]
    T.write_index(after, str(tmp_path / "ix"), 4)
    again = T.read_index(spark, str(tmp_path / "ix"), "id")
    assert ids(T.match_text(again, any=["zebra"])) == [5]
    plan = T.match_text(again, any=["zebra"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "zebra" in plan


def test_rendering_and_export(spark, tmp_path):
    hits = spark.createDataFrame([("sub:1", "/a", 0.5), ("sub:2", "/b", 0.25)], "sub_id string, path string, score double")
    assert sorted(r.line for r in render_hits(hits).collect()) == ["0.2500  sub:2  /b", "0.5000  sub:1  /a"]
    assert '{"sub_id":"sub:1","path":"/a","score":0.5}' in [r.line for r in render_hits(hits, "json").collect()]
    assert render_hits(hits.drop("score")).count() == 2
    export_layers({"habits": hits, "graph": hits.limit(1)}, str(tmp_path), "json")
    assert spark.read.json(f"{tmp_path}/layer=habits").count() == 2


def test_scripts_and_prefixes(spark):
    texts = [(1, "한국 사람"), (2, "ガラス の 家"), (3, "Tiếng Việt nam"), (4, "old newt"), (5, "new york"), (6, "new old yo")]
    found = T.build_postings(spark.createDataFrame(texts, "id int, t string"), "id", ["t"])
    find = lambda **q: {r.id for r in T.match_text(found, **q).collect()}
    assert find(all=["한국"]) == {1} and find(all=["ガラス"]) == {2} and find(all=["viet"]) == {3} and find(all=["Việt"]) == {3}
    assert find(prefix="new yo") == {5} and find(prefix="new") == {4, 5, 6} and find(prefix="") == set() and find(phrase="...") == set()
