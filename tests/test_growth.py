"""What the cost of a job grows with: shuffles that aren't there, tasks of bounded size, joins that are left out."""

import glob
import hashlib

import pyarrow as pa
import pyarrow.parquet as pq

from cairnfield.operators import blocks as K
from cairnfield.operators import embedding as E
from cairnfield.operators import segments as S
from cairnfield.operators import textsearch as T


def texts(spark, n=60, parts=3):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 11}" for j in range(i % 9))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, body string").repartition(parts, "id")


def test_words_are_not_shuffled(spark, monkeypatch):
    source = spark.createDataFrame([(1, "a b a", "É x"), (2, None, "")], "id long, body string, head string")
    index = T.build_postings(source, "id", ["body", "head"])
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, index.postings.collect()))
    assert got == [("a", 1, "body", 2, [0, 2]), ("b", 1, "body", 1, [1]), ("e", 1, "head", 1, [0]), ("x", 1, "head", 1, [1])]
    batch = pa.record_batch([pa.array([5, 6, 7, 8]), pa.array([["b", "a", "b"], [], ["a"], ["c", "c", "c", "b"]])], ["id", "_0"])
    want = [("a", 5, 1, [1]), ("a", 7, 1, [0]), ("b", 5, 2, [0, 2]), ("b", 8, 1, [3]), ("c", 8, 3, [0, 1, 2])]
    for words, rows in ((1, 1), (2, 2), (4, 3), (100, 100)):
        monkeypatch.setattr(T, "TOKENS_AT_ONCE", words)
        monkeypatch.setattr(T, "POSTINGS_AT_ONCE", rows)
        made = [r for b in T._gather("id", ["body"])(iter([batch.slice(0, 3), batch.slice(3), batch.slice(0, 0)])) for r in b.to_pylist()]
        assert sorted((r["term"], r["id"], r["tf"], r["positions"]) for r in made) == want


def test_a_refresh_looks_for_large_texts_in_their_lengths(spark, monkeypatch):
    index = T.build_postings(texts(spark), "id", ["body"])
    hot = {r["_k_id"]: r["_salts"] for r in T.hot_keys(index.lengths, "id", 7).collect()}
    assert hot == {i: 2 for i in range(60) if i % 9 == 8}
    given = []
    join = T.salted_join
    monkeypatch.setattr(T, "salted_join", lambda *a, hot=None, **k: given.append(hot) or join(*a, hot=hot, **k))
    after = T.refresh_postings(index, T.build_postings(texts(spark, 1), "id", ["body"]), texts(spark).filter("id = 8").select("id"))
    assert given[0] is not None and 8 not in {r.id for r in after.postings.collect()}


def test_large_texts_are_told_without_counting_words(spark, monkeypatch):
    index = T.build_postings(texts(spark), "id", ["body"])
    given, found = [], T.hot_keys
    monkeypatch.setattr(T, "hot_keys", lambda lengths, key: given.append(lengths) or found(lengths, key))
    T.refresh_postings(index, T.build_postings(texts(spark, 1), "id", ["body"]), texts(spark).filter("id = 8").select("id"))
    want = {r.id: len(r.body.encode()) for r in texts(spark).collect()}
    assert {r.id: r.length for r in given[0].collect()} == want
    assert "regexp" not in given[0]._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_segment_is_sorted_task_by_task(spark, tmp_path):
    S.SegmentedIndex(spark, str(tmp_path), "id").refresh(T.build_postings(texts(spark), "id", ["body"]))
    files = [pq.read_table(f)["term"].to_pylist() for f in glob.glob(f"{tmp_path}/segment-1/postings/*.parquet")]
    assert len(files) == 3 and all(f == sorted(f) for f in files)


def test_blocks_are_full_at_most(spark):
    index = T.build_postings(texts(spark, 400), "id", ["body"])
    rows = K.build_blocks(index, 4).blocks.collect()
    assert max(r.n for r in rows) == 4 and all(len(r.entries) == r.n and r.best == max(e.weight for e in r.entries) for r in rows)
    assert sorted((r.term, e.key) for r in rows for e in r.entries) == sorted((r.term, r.id) for r in index.postings.collect())


def test_words_become_slots_where_they_are_read(spark):
    batch = pa.record_batch([pa.array([5, 6, 7]), pa.array([["b", "a", "b"], [], ["é"]])], ["id", "words"])
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64
    got = [tuple(r.values()) for b in E._slots("id", 64)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sorted(got) == sorted([(5, slot("a"), 1.0), (5, slot("b"), 2.0), (7, slot("é"), 1.0)])
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "..."), (4, "b")], "id long, body string")
    made = E.embed_text(rows, 64, "id", "body")
    assert {r.id for r in made.collect()} == {1, 4} and "Generate" not in made._jdf.queryExecution().executedPlan().toString()
