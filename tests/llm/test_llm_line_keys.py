"""Keys of lines: made by one short expression, and the same ones as by hand; blank lines by their first other character."""

from pyspark.sql import functions as F

from cairnfield.llm import linededup


def _segment(length: int, i: int, threshold: int) -> tuple[int, int]:
    base, rest = divmod(length, threshold + 1)
    return i * base + max(0, i - threshold - 1 + rest), base + (i >= threshold + 1 - rest)


def test_keys_are_those_of_the_places(spark):
    lines = ["abc", "äöü€𝒳z", "The quick brown fox jumps", "Page 12 of the long ünïcode line"]
    df = spark.createDataFrame([(i, 0, x, len(x)) for i, x in enumerate(lines)], "id long, letters long, line string, n int")
    for places in (linededup._index_places(2), linededup._probe_places(2)):
        want = []
        for number, line in enumerate(lines):
            for shorter, i, shift in places:
                start, size = _segment(len(line) - shorter, i, 2)
                at = start + shift
                if at >= 0 and at + size <= len(line):
                    want.append((number, len(line) - shorter, i, line[at : at + size]))
        named = spark.createDataFrame(want, "id long, target int, i int, part string")
        hashed = named.select("id", F.xxhash64("target", "i", "part").alias("key"))
        got = linededup._keyed(df, places, 2).select("id", "key")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hashed.collect()))


def test_no_key_expression_is_repeated_for_every_place(spark):
    df = spark.createDataFrame([(1, 0, "The quick brown fox jumps", 25)], "id long, letters long, line string, n int")
    plan = linededup.near_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    # One hash for each side of the two joins.
    assert plan.count("xxhash64(") <= 4


def test_blank_lines(spark):
    lines = ["", " ", "\t \r", " x", "x ", " ", "\u000b", "\r\ta"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(linededup.blank(F.col("line"))).collect()
    assert [r[0] for r in got] == [x.strip(" \t\r") == "" for x in lines]
