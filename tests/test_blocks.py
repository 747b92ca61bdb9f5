"""Search over blocks against full scoring, and how many blocks it reads."""

import random

import pytest

from cairnfield.operators import blocks as K
from cairnfield.operators import textsearch as T


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60))), rng.choice(["w0", "w1 w2", ""])) for i in range(3000)]
    rows += [(3000 + i, "w39 " * 3 + "w0", "") for i in range(30)]  # ties
    plain = T.build_postings(spark.createDataFrame(rows, "id long, body string, head string"), "id", ["body", "head"])
    plain = T.TextIndex(plain.postings.cache(), plain.lengths.cache(), "id")
    made = K.build_blocks(plain, 16)
    return plain, K.BlockIndex(made.blocks.cache(), made.texts, "id")


@pytest.mark.parametrize("asked", [{"any": ["w0"]}, {"any": ["W39", "w5"]}, {"any": ["w1", "w30", "w38"]}, {"all": ["w0", "w39"]}, {"all": ["w3"]}, {"any": ["none", "w7"]}])
@pytest.mark.parametrize("limit", [1, 10, 100])
def test_equal_to_full_scoring(index, asked, limit):
    plain, made = index
    want = T.search_text(plain, limit=limit, **asked).collect()
    got = K.search_blocks(made, limit=limit, **asked).collect()
    assert [r["rank"] for r in got] == pytest.approx([r["rank"] for r in want])
    last = want[-1]["rank"]
    clear = lambda rows: {r.id for r in rows if r["rank"] < last - 1e-9}
    assert clear(got) == clear(want)


def test_few_blocks_are_read(index):
    _, made = index
    for words, share in ((["w0"], 0.2), (["w1", "w30"], 0.9)):
        asked = made.blocks.filter(made.blocks.term.isin(*words)).count()
        assert K.needed_blocks(made, words, 10)[0].count() < share * asked


def test_nothing_to_find(index):
    _, made = index
    assert K.search_blocks(made, any=["absent"]).collect() == [] and K.search_blocks(made, all=["w0", "absent"]).collect() == []
    assert K.search_blocks(made, any=["..."]).collect() == []
    with pytest.raises(ValueError):
        K.search_blocks(made)
    empty = T.TextIndex(index[0].postings.limit(0), index[0].lengths.limit(0), "id")
    assert K.search_blocks(K.build_blocks(empty), any=["w0"]).collect() == []


def test_stored_blocks_are_skipped_by_statistics(spark, index, tmp_path):
    _, made = index
    K.write_blocks(made, str(tmp_path), 4)
    again = K.read_blocks(spark, str(tmp_path), made.texts, "id")
    found = K.search_blocks(again, limit=5, any=["w0"])
    assert [r.id for r in found.collect()] == [r.id for r in K.search_blocks(made, limit=5, any=["w0"]).collect()]
    plan = K.needed_blocks(again, ["w0"], 5)[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(best," in plan and "EqualTo(term,w0)" in plan
