import functools
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnfield.functions import vectors as V
from cairnfield.operators import cells as C
from cairnfield.operators import embedding as E
from cairnfield.operators import similarity as N

SCHEMA = "item_id long, content_hash string, vec array<float>"


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    m = centres[rng.integers(0, 6, 240)] + 0.25 * rng.normal(size=(240, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[100:180] = m[100]  # a third of the rows are copies
    m = m.astype(np.float32)
    df = spark.createDataFrame([(i, f"h{i}", [float(x) for x in v]) for i, v in enumerate(m)], SCHEMA).cache()
    return df, m.astype(np.float64)


def test_knn_small_cases(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [0.8, 0.6]), (3, "c", [0.0, 1.0]), (4, "a", [1.0, 0.0]), (5, "d", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    ask = F.col("item_id") == 1
    assert [r.item_id for r in N.knn(df, ask, 10).collect()] == [2, 3]  # own content and other lengths left out
    assert N.knn(df, ask, 0).count() == 0
    assert N.knn(df, F.col("item_id") == 99, 3).count() == 0


@pytest.mark.parametrize("shipped", [1000, 0])
def test_knn_join_is_exact(cloud, shipped, monkeypatch):
    df, m = cloud
    monkeypatch.setattr(C, "TILE_QUERIES", 50)
    monkeypatch.setattr(C, "BLOCK_ROWS", 30)
    monkeypatch.setattr(N, "knn_cells", functools.partial(C.knn_cells, rows_per_pivot=20))
    got = {}
    for r in N.knn_join(df, df, 4, shipped).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.item_id
    scores = m @ m.T
    np.fill_diagonal(scores, -9)
    for q in range(len(m)):
        want = sorted(range(len(m)), key=lambda i: (-scores[q, i], i))[:4]
        mine = [got[q][r] for r in (1, 2, 3, 4)]
        assert np.allclose([scores[q, i] for i in mine], [scores[q, i] for i in want])
        exact = [i for i in mine if scores[q, i] > scores[q, want[-1]] + 1e-6]
        assert set(exact) <= set(want)


@pytest.mark.parametrize("cell_rows,pivots", [(4096, 8), (20, 5), (20, 1)])
def test_similar_edges_is_exact(cloud, cell_rows, pivots):
    df, m = cloud
    edges = N.similar_edges(df.select("item_id", "vec"), 0.9, pivots, cell_rows).collect()
    got = {(r.src, r.dst) for r in edges}
    assert len(got) == len(edges)
    reps = [i for i in range(240) if not 100 < i < 180]
    scores = m @ m.T
    want = {(a, b) for a in reps for b in reps if a < b and scores[a, b] >= 0.9} | {(100, i) for i in range(101, 180)}
    assert got == want


def test_embedders_coexist_and_isolate(spark):
    df = spark.createDataFrame([("h1", "abc"), ("h2", "zz"), ("h3", "")], "content_hash string, content string")

    def lengths(s):
        return [1.0 / len(s), float(len(s))]

    ok, bad = E.embed(df, "len", 2, lengths)
    assert sorted(r.content_hash for r in ok.collect()) == ["h1", "h2"]
    assert bad.first().error.startswith("ZeroDivisionError")
    ok2, _ = E.embed_new(df, ok, "len", 2, lengths)
    assert ok2.count() == 0
    other, _ = E.embed(df, "one", 1, lambda s: [1.0])
    assert {r.model for r in ok.unionByName(other).collect()} == {"len", "one"}
    _, wrong = E.embed(df.limit(1), "bad", 3, lambda s: [1.0])
    assert wrong.first().error == "expected 3 finite values"


def test_vector_validation(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, None), (5, [1.0, float("nan")]), (6, [None, 1.0])]
    ok, bad = E.validate_vectors(spark.createDataFrame(rows, "id int, vec array<float>"), 2)
    assert [r.id for r in ok.collect()] == [1]
    assert {r.id: r.problem for r in bad.collect()} == {
        2: "wrong length", 3: "empty", 4: "empty", 5: "null or NaN component", 6: "null or NaN component"
    }


def test_normalise_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    got = [r[0] for r in df.select(V.l2_normalize(F.col("v"))).collect()]
    assert got[0] == [0.0, 0.0]
    assert got[1] == pytest.approx([0.6, 0.8])


def test_text_embedding_matches_brute_force(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red hen"), (3, "blue whale")], "doc_id long, text string")
    vecs = {r.doc_id: np.array(r.vec) for r in E.embed_text(docs, 128).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in vecs.values())
    assert vecs[1] @ vecs[2] > vecs[1] @ vecs[3]


def test_plans(spark, cloud):
    df, _ = cloud
    plan = N.knn(df, F.col("item_id") == 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    joined = N.knn_join(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in joined


def test_edges_cover_every_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [0.99, 0.1, 0.0])]
    got = {(r.src, r.dst) for r in N.similar_edges(spark.createDataFrame(rows, "item_id long, vec array<float>"), 0.9).collect()}
    assert got == {(1, 2), (10, 11)}


def clustered(spark, n, dim, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n // 20, dim))[rng.integers(0, n // 20, n)] + spread * rng.normal(size=(n, dim))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    return spark.createDataFrame([(i, f"h{i}", [float(x) for x in v]) for i, v in enumerate(m)], SCHEMA), m.astype(np.float64)


def test_cells_visit_few_rows_and_stay_exact(spark, monkeypatch):
    df, m = clustered(spark, 3000, 8, 1, 0.1)
    rows = []
    monkeypatch.setattr(C, "meet", lambda asked, base, k, f=C.meet: (rows.append((asked, base)), f(asked, base, k))[1])
    got = {}
    for r in C.ranked(C.knn_cells(df, df, 3, rows_per_pivot=30), 3).collect():
        got.setdefault(r.query_id, []).append(r.score)
    scores = m @ m.T
    np.fill_diagonal(scores, -9)
    want = -np.sort(-scores, axis=1)[:, :3]
    assert np.allclose(np.array([sorted(got[i], reverse=True) for i in range(3000)]), want, atol=1e-6)
    visits, base = rows[-1]
    sizes = {r.cell: r["count"] for r in base.groupBy("cell").count().collect()}
    met = sum(sizes[r.cell] * r["count"] for r in visits.groupBy("cell").count().collect())
    assert met < 3000 * 3000 / 5  # pairs of rows that meet


def test_copies_of_a_vector_do_not_meet_each_other_all(spark):
    rows = [(i, f"h{i % 3}", [1.0, 0.0]) for i in range(600)] + [(700, "x", [0.6, 0.8]), (701, None, [0.0, 1.0]), (702, "z", None), (703, "y", [])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert C._reduced(df.filter("size(vec) > 0"), 2).count() == 6
    got = {}
    for r in N.knn_join(df, df, 2, shipped=0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got[0] == [1, 2] and got[1] == [0, 2] and got[5] == [0, 1] and got[700][0] == 701 and 702 not in got and 703 not in got
    assert len(got) == 602


def test_similar_to_is_exact_when_small(cloud):
    df, m = cloud
    got = {}
    for r in C.similar_to(df, 3, 0.5).collect():
        got.setdefault(r.src, []).append(r.score)
    scores = m @ m.T
    np.fill_diagonal(scores, -9)
    for i in range(len(m)):
        want = [s for s in sorted(scores[i], reverse=True)[:3] if s >= 0.5]
        assert np.allclose(sorted(got.get(i, []), reverse=True), want, atol=1e-6)


def test_similar_to_recall_and_visits(spark, monkeypatch):
    visits = {}
    for n in (2000, 8000):
        df, m = clustered(spark, n, 32, n)
        seen = []
        with monkeypatch.context() as patch:
            patch.setattr(C, "FIRST_ROWS", 128)
            patch.setattr(C, "meet", lambda asked, base, k, f=C.meet, seen=seen: (seen.append((asked, base)), f(asked, base, k))[1])
            found = {(r.src, r.dst) for r in C.similar_to(df, 5, 0.7, bucket_rows=256).collect()}
        scores = m @ m.T
        np.fill_diagonal(scores, -9)
        want = {(i, int(j)) for i in range(n) for j in np.argsort(-scores[i])[:5] if scores[i, j] >= 0.7}
        assert len(found & want) >= 0.9 * len(want) > 1000
        asked, base = seen[0]
        sizes = {r.cell: r["count"] for r in base.groupBy("cell").count().collect()}
        assert max(sizes.values()) <= 256
        visits[n] = sum(sizes.get(r.cell, 0) * r["count"] for r in asked.groupBy("cell").count().collect()) / n
    assert visits[8000] < 1.5 * visits[2000]


def test_hot_buckets_are_split(spark):
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16))])
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    m[:300] = m[0]  # copies, which no plane parts
    df = spark.createDataFrame([(i, f"h{i}", [float(x) for x in v]) for i, v in enumerate(m)], SCHEMA)
    found = C.similar_to(df, 4, 0.9, tables=2, bucket_rows=100).collect()
    assert {r.src for r in found} >= set(range(900)) and all(r["rank"] <= 4 for r in found)


def test_similar_to_query_is_exact_beyond_one_bucket(spark, tmp_path):
    from cairnfield.plans import load_all

    rng = np.random.default_rng(7)
    m = rng.normal(size=(5000, 64))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    m[4990:] = m[17]
    ids = np.arange(5000)
    pd.DataFrame({"vec_id": ids, "embedding": list(m), "label": ids % 10}).to_parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(5000).selectExpr("id AS event_id", "timestamp_ntz'2026-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {}
    for r in load_all()[0]["similar_to"](spark, str(tmp_path)).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    m = m.astype(np.float64)
    for q in range(5000):
        scores = C.pair_scores(np.broadcast_to(m[q], m.shape), m)
        scores[q] = -9
        want = [int(i) for i in np.lexsort((ids, -scores))[:8] if scores[i] >= 0.3]
        assert got.get(q, []) == want, q


def test_a_task_of_neighbours_holds_little():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(10_000, 16))
    rows = pd.DataFrame({"item_id": np.arange(10_000), "content_hash": [f"h{i}" for i in range(10_000)], "vec": list(m)})
    tracemalloc.start()
    found = C.top_of(rows.iloc[:4096], rows, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 3 * 4096 and peak < 100 << 20


def test_visitors_of_a_cell_do_not_meet(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(600, 16))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "item_id long, vec array<float>")
    tiles = []
    grouped = type(df.groupBy("item_id"))
    monkeypatch.setattr(grouped, "applyInPandas", lambda self, f, schema, old=grouped.applyInPandas: (tiles.append(self._df), old(self, f, schema))[1])
    edges = {(r.src, r.dst) for r in N.similar_edges(df, 0.3, pivots=8, cell_rows=40).collect()}
    scores = m.astype(np.float64) @ m.T.astype(np.float64)
    assert edges == {(int(i), int(j)) for i, j in np.argwhere(scores >= 0.3) if i < j}
    sides = tiles[0].groupBy("cell", "_lo", "_hi", "_mine").count().groupBy("cell", "_lo", "_hi").agg(F.collect_list("count").alias("n")).collect()
    met = sum(r.n[0] * (r.n[1] if len(r.n) > 1 else r.n[0] / 2) for r in sides)
    assert met < 0.6 * 600 * 600  # pairs of rows that meet; half of 600 * 600 is the least without pruning
