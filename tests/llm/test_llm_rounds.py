"""A large group of near copies is linked in rounds, without comparing all its pairs."""

import random

from cairnfield.llm import setjoin


def _copies(n: int) -> list[tuple[int, str]]:
    rng = random.Random(7)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for k in range(n):
        words = list(base)
        for j in rng.sample(range(150), rng.choice([1, 2, 3, 3, 4])):
            words[j] = f"edit{k}x{j}"
        texts.append((k, " ".join(words)))
    return texts


def _sets(texts):
    return {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in texts}


def _expected(sets) -> dict[int, int]:
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def test_pairs_of_near_copies_grow_with_the_group(spark, monkeypatch):
    counts: dict[str, int] = {}

    class Counted(setjoin.Step):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name in ("asked", "open"):
                counts[name] = counts.get(name, 0) + self.df.count()

    monkeypatch.setattr(setjoin, "Step", Counted)
    texts = _copies(240)
    found = setjoin.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == _expected(_sets(texts))
    assert counts["asked"] + counts["open"] <= 10 * len(texts), counts
