"""Queries that answer for the whole table, against brute force over its rows."""

import itertools
from collections import Counter

import duckdb

from __spark_entry__ import queries

QUERIES = queries()


def lineage(sf):
    edges = {}
    sql = f"""SELECT 'cust:' || o_custkey, 'order:' || o_orderkey FROM '{sf}/orders.parquet'
        UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM '{sf}/lineitem.parquet'"""
    for output, source in duckdb.sql(sql).fetchall():
        edges.setdefault(output, set()).add(source)
    return edges


def behind(edges, output):
    """Everything behind one output with the fewest steps to it."""
    depth, frontier, n = {}, {output}, 0
    while frontier:
        n += 1
        frontier = {x for node in frontier for x in edges.get(node, ()) if x not in depth}
        depth.update(dict.fromkeys(frontier, n))
    return depth


def test_provenance_of_every_output(spark, sf):
    edges = lineage(sf)
    want = {(output, source): n for output in edges for source, n in behind(edges, output).items()}
    assert any(not output.endswith("0") for output, _ in want) and any(output.startswith("order:") for output, _ in want)
    got = QUERIES["provenance_closure"](spark, sf).collect()
    assert len(got) == len(want) and {(r.output, r.source): r.depth for r in got} == want


def test_two_hops_from_every_customer(spark, sf):
    edges = lineage(sf)
    customers = [x for x in edges if x.startswith("cust:")]
    want = {(seed, node): n for seed in customers for node, n in behind(edges, seed).items() if n <= 2}
    assert any(not seed.endswith("0") for seed, _ in want)
    got = QUERIES["graph_2hop"](spark, sf).collect()
    assert len(got) == len(want) and {(r.seed, r.node): r.hops for r in got} == want


def test_all_parts_of_an_order_are_partners(spark, sf):
    orders = {}
    for order, part in duckdb.sql(f"SELECT DISTINCT l_orderkey, l_partkey FROM '{sf}/lineitem.parquet'").fetchall():
        orders.setdefault(order, []).append(part)
    want = Counter(pair for parts in orders.values() for pair in itertools.combinations(sorted(parts), 2))
    got = QUERIES["used_with_all_pairs"](spark, sf).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.weight for r in got} == want
    narrow = {(r.a, r.b) for r in QUERIES["used_near_pairs"](spark, sf).collect()}
    assert narrow < set(want)  # parts further apart than the span are only here


def test_any_two_entities_of_a_document_are_met(spark, sf):
    documents = {}
    for r in QUERIES["entity_mentions"](spark, sf).collect():
        documents.setdefault(r.doc_id, []).append(r.entity)
    want = Counter(pair for names in documents.values() for pair in itertools.permutations(names, 2))
    assert any(" " in a and " " in b for a, b in want)
    got = QUERIES["entity_cooccurrence"](spark, sf).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.weight for r in got} == want
