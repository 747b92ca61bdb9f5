"""The segmented index against one that is built anew, and what a refresh writes."""

import os
import random

import pytest

from cairnfield.operators import segments as S
from cairnfield.operators import textsearch as T


def built(spark, rows):
    return T.build_postings(spark.createDataFrame(rows, "id long, body string"), "id", ["body"])


def rows_of(index):
    postings = sorted((r.term, r.id, r.tf, tuple(r.positions)) for r in index.postings.collect())
    return postings, sorted(map(tuple, index.lengths.select("id", "length").collect()))


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_refreshes_equal_a_new_index(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choices(["a", "bee", "cat", "dog", "eel"], k=rng.randint(0, 6)))
    now = {i: text() for i in range(30)}
    index = S.SegmentedIndex(spark, str(tmp_path), "id")
    with pytest.raises(ValueError):
        index.read()
    monkeypatch.setattr(S, "MERGED_AT_ONCE", 3)
    index.refresh(built(spark, list(now.items())))
    for step in range(5):
        changed = {rng.randrange(34): text() for _ in range(3)}
        gone = [rng.randrange(30) for _ in range(2)] if step % 2 else []
        for i in gone:
            now.pop(i, None)
        now.update(changed)
        removed = spark.createDataFrame([(i,) for i in gone], "id long") if gone else None
        index.refresh(built(spark, list(changed.items())), removed)
    assert rows_of(index.read()) == rows_of(built(spark, list(now.items())))
    assert len(index.live()) < 6  # some were merged
    index.clean()
    assert rows_of(index.read()) == rows_of(built(spark, list(now.items())))
    assert len([n for n in os.listdir(tmp_path) if n.startswith("segment-")]) == len(index.live())


def test_a_small_refresh_writes_little(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in range(4000)]
    index = S.SegmentedIndex(spark, str(tmp_path), "id")
    index.refresh(built(spark, rows))
    before = {n: os.stat(tmp_path / n).st_mtime_ns for n in os.listdir(tmp_path) if n.startswith("segment-")}
    whole = size(tmp_path)
    index.refresh(built(spark, rows[:40]))  # one in a hundred
    assert size(tmp_path) - whole < 0.1 * whole
    assert {n: os.stat(tmp_path / n).st_mtime_ns for n in before} == before
    assert {r.id for r in T.match_text(index.read(), any=[rows[7][1].split()[0]]).collect()} >= {7}
