"""Pairs and closures: what is read once, what is dealt, which joins are left out."""

from cairnfield.operators import graph as G
from cairnfield.operators import journal as L
from cairnfield.plans import insight_queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_dealt_by_their_number(spark):
    rows = [(i // 5, (i * 37) % 101, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, item long, p int")
    for make in (
        lambda n: G.used_near(df, "g", "item", "p", 2, pair_rows=n),
        lambda n: G.all_partners(G.membership(df, "g", "item"), "g", "item", pair_rows=n),
        lambda n: G.partners_of(G.membership(df, "g", "item"), df.filter("item < 9"), "g", "item", pair_rows=n),
    ):
        few, many = make(1_000_000), make(50)
        assert "REPARTITION_BY_NUM" in plan(many) and "REPARTITION_BY_NUM" not in plan(few)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) != []
    assert G.all_partners(df.limit(0), "g", "item").collect() == []


def test_members_are_made_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, None)], "g long, item string")
    found = G.partners_of(G.membership(df, "g", "item"), None, "g", "item")
    assert "ExistingRDD" not in plan(found) and "LocalTableScan" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", "b", 2), ("b", "a", 2)]


def test_ends_of_a_lineage_are_not_joined(spark, monkeypatch):
    edges = spark.createDataFrame([("c", "o"), ("o", "p"), ("o", "q"), ("x", "x")], "output string, input string")
    joined = []
    join = L.salted_join
    monkeypatch.setattr(L, "salted_join", lambda big, small, *a, **k: joined.append(small.count()) or join(big, small, *a, **k))
    want = [("c", "o", 1), ("c", "p", 2), ("c", "q", 2), ("o", "p", 1), ("o", "q", 1), ("x", "x", 1)]
    assert sorted(map(tuple, L.provenance(edges).collect())) == want
    assert joined == [3, 2]  # the marks, then c over o and x over itself
    asked = spark.createDataFrame([("c",)], "output string")
    assert sorted(map(tuple, L.provenance(edges, asked).collect())) == want[:3]
    assert L.provenance(edges, asked.limit(0)).collect() == []


def test_customers_come_from_orders_alone(spark, sf, monkeypatch):
    seeds = []
    monkeypatch.setattr(Q.G, "k_hop", lambda edges, start, k: seeds.append(start) or edges)
    Q.graph_2hop(spark, sf)
    assert "l_orderkey" not in plan(seeds[0])
