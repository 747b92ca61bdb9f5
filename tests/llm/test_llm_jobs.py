"""What the driver keeps of a run grows with its jobs, stages and tasks: the Jaccard join makes few of them."""

import random

from test_llm_rounds import _copies, _expected, _sets

from cairnfield.llm import setjoin
from cairnfield.llm.components import components


def _roots(pairs) -> dict:
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_large_group_takes_few_jobs(spark):
    texts = _copies(240)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    found = setjoin.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"))
    took = jobs() - before
    assert {r.doc_id: r.component_id for r in found.collect()} == _expected(_sets(texts))
    assert took <= 240, took  # 270 with whole components after each round


def test_stars_join_the_same_nodes(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FOREST_NODES", 40)
    some = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(a, b) for a, b in ((some.randrange(90), some.randrange(90)) for _ in range(60)) if a != b]
    for kind, name in ((int, "long"), (str, "string")):
        typed = [(kind(a), kind(b)) for a, b in pairs]
        df = spark.createDataFrame(typed, f"a {name}, b {name}").repartition(3)
        stars = [tuple(r) for r in setjoin._forest(df).collect()]
        assert _roots(stars) == _roots(typed)


def test_gathered_labels_lose_no_link(spark):
    """Labels after any rounds join linked nodes only, a component is none of their nodes, and the last merge is whole."""
    some = random.Random(5)
    rounds = [[(0, i) for i in range(1, 9)] + [(20 + i, 21 + i) for i in range(12)]]
    rounds += [[(a, b) for a, b in ((some.randrange(60), some.randrange(60)) for _ in range(25)) if a != b] for _ in range(3)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    label, seen = components(frame(rounds[0])), list(rounds[0])
    for pairs in rounds[1:]:
        seen += pairs
        label = setjoin._gathered(label, frame(pairs))
        rows, true = {r.node: r.component for r in label.collect()}, _roots(seen)
        assert len(rows) == label.count()
        assert all(true[n] == true[c] for n, c in rows.items())
        assert not set(rows) & set(rows.values())
    whole = {r.node: r.component for r in setjoin._merged(label, frame(seen)).collect()}
    assert whole == {n: c for n, c in _roots(seen).items() if n != c}
