"""Blocks of index lists: pairs of blocks that are skipped, and that none of the pairs they may not lose is lost."""

import random

from cairnfield.llm import setjoin


def test_blocks_are_skipped(spark):
    some = random.Random(9)
    rows = []
    for rep in range(600):  # one list of sets of very different sizes and places, and short lists
        n = some.choice([20, 50, 100, 200, 400])
        rows.append((7, rep, n, some.randrange(n // 5 + 1), rep // 2))
    rows += [(100 + i, 2 * i + j, 50, some.randrange(11), 2 * i + j) for i in range(50) for j in (0, 1)]
    lists = spark.createDataFrame(rows, "s long, rep long, n long, pos long, c long")
    entries = setjoin._in_blocks(lists).cache()

    def possible(x, y):
        small, large = sorted((x[2], y[2]))
        return small * 100 >= large * 80 and min(x[2] - x[3], y[2] - y[3]) >= -(-80 * (small + large) // 180)

    want = {(x[1], y[1], x[0]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[4] != y[4] and possible(x, y)}
    got = [tuple(r) for r in setjoin._members(entries, 80).collect()]
    assert set(got) == want and len(want) > 1000
    assert len(got) == len(want)  # each pair comes once from a list

    held = {(r.s, r.block): r[2] for r in entries.groupBy("s", "block").count().collect()}
    kept = setjoin._block_pairs(entries, 80).collect()
    blocks = [b for s, b in held if s == 7]
    met = sum(held[7, r.block] * held[7, r.y_block] for r in kept if r.s == 7)
    assert len(blocks) > 10
    assert sum(r.s == 7 for r in kept) < len(blocks) ** 2 / 4
    assert met < 600**2 / 4
    entries.unpersist()
