"""Sliced ordered operations equal plain windows when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnfield.operators import ordered as O
from cairnfield.operators.skew import lookup_join, salted_join


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(30)}", rnd.randrange(3000), i, rnd.randrange(-5, 9)) for i in range(900)]
    data += [(None, 5, 2000, 1), (None, 6, 2001, 2)]
    return spark.createDataFrame(data, "key string, at long, id long, v long").cache()


def as_set(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("target", [7, 60, 10_000])
def test_neighbours(rows, target):
    sliced = O.slice_keys(rows, ["key"], F.col("at"), target)
    if target == 7:
        assert sliced.filter("_slice > 3").count() > 0
    if target == 10_000:
        assert O.SLICE not in sliced.columns
    got = O.neighbours(sliced, ["key"], ["at", "id"], back={"p1": ("v", 1), "p3": ("v", 3)}, ahead={"n2": ("v", 2)})
    w = Window.partitionBy("key").orderBy("at", "id")
    want = rows.withColumns({"p1": F.lag("v", 1).over(w), "p3": F.lag("v", 3).over(w), "n2": F.lead("v", 2).over(w)})
    cols = ["key", "at", "id", "v", "p1", "p3", "n2"]
    assert as_set(got, cols) == as_set(want, cols)


@pytest.mark.parametrize("target", [7, 10_000])
@pytest.mark.parametrize("keys", [["key"], []])
def test_running(rows, target, keys):
    sliced = O.slice_keys(rows, keys, F.col("at"), target)
    got = O.running(sliced, keys, ["at", "id"], sums={"s": F.col("v")}, maxima={"m": F.col("v")})
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w)})
    assert as_set(got, ["id", "s", "m"]) == as_set(want, ["id", "s", "m"])


def test_same_instant_rows_stay_together(spark):
    df = spark.range(50).select(F.lit("k").alias("key"), F.lit(1).alias("at"), "id", F.lit(1).alias("v"))
    sliced = O.slice_keys(df, ["key"], F.col("at"), 5)
    got = O.running(sliced, ["key"], ["at", "id"], sums={"n": F.lit(1)})
    assert [r.n for r in got.orderBy("id").collect()] == list(range(1, 51))


def test_sessions_split_anywhere(rows):
    plain = O.sessionize(rows, ["key"], "at", 20, "id", 10_000)
    sliced = O.sessionize(rows, ["key"], "at", 20, "id", 7)
    cols = ["key", "id", "session_no"]
    assert as_set(plain, cols) == as_set(sliced, cols)


@pytest.mark.parametrize("target", [20, 10_000])
def test_exact_quantile(rows, target):
    got = {r.key: r.q for r in O.exact_quantile(rows, ["key"], "at", 0.95, "q", target).collect()}
    want = {r.key: r.q for r in rows.groupBy("key").agg(F.percentile("at", F.lit(0.95)).alias("q")).collect()}
    assert got.keys() - {None} == want.keys() - {None}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want if k is not None)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, rows, how):
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "key string, x int")
    got = salted_join(rows, small, ["key"], how, spread=["id"], target_rows=20)
    want = rows.join(small, "key", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    for limit in (1, 100):
        looked = lookup_join(rows, small, ["key"], how, ["id"], limit)
        assert looked.count() == want.count()


def test_null_positions_keep_their_rows(spark):
    df = spark.createDataFrame([("k", None if i % 10 == 0 else i, i) for i in range(100)], "key string, at long, id long")
    sliced = O.slice_keys(df, ["key"], F.col("at"), 20)
    assert sliced.filter("_slice is null").count() == 0 and sliced.filter("_slice = 1").count() == 10
    got = O.running(sliced, ["key"], ["at", "id"], sums={"n": F.lit(1)})
    want = [r.id for r in df.orderBy(F.col("at").asc_nulls_first(), "id").collect()]
    assert [(r.id, r.n) for r in got.orderBy("n").collect()] == list(zip(want, range(1, 101), strict=True))
    assert O.neighbours(sliced, ["key"], ["at", "id"], back={"p": ("id", 1)}).filter("p is not null").count() == 99


def test_outliers_do_not_widen_slices(spark):
    df = spark.createDataFrame([("k", 0 if i == 0 else 10**9 + i, i) for i in range(1000)], "key string, at long, id long")
    sizes = [r["count"] for r in O.slice_keys(df, ["key"], F.col("at"), 100).groupBy("_slice").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 200


def test_hot_null_keys_are_dealt_out(spark):
    df = spark.createDataFrame([(None if i % 10 else i, i) for i in range(1000)], "k int, id int")
    small = spark.createDataFrame([(0, "a"), (10, "b"), (None, "c")], "k int, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got, want = (sorted(map(str, j.collect())) for j in (salted_join(df, small, ["k"], how, target_rows=50), df.join(small, "k", how)))
        assert got == want
