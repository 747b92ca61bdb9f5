"""Stores in buckets: what a run writes and what it leaves where it was."""

import os

from pyspark.sql import functions as F

from cairnfield.functions.identity import content_hash
from cairnfield.operators import catalog as C
from cairnfield.sources.buckets import BUCKET, Places, bucket_of, clean_runs, latest_run
from cairnfield.sources.catalog_store import empty_catalog, load_catalog, save_catalog
from cairnfield.streaming.attention import balances, keep_attention
from cairnfield.streaming.maintenance import apply_batch

CHANGE = "path string, size long, mtime long, content string, kind string"


def stamps(store):
    """Bucket folders of the store with the times of their files."""
    found = {}
    for at, _, names in os.walk(store):
        if os.path.basename(at).startswith(f"{BUCKET}="):
            found[os.path.relpath(at, store)] = sorted(os.stat(os.path.join(at, n)).st_mtime_ns for n in names if n.endswith(".parquet"))
    return found


def test_a_ten_file_batch_writes_no_untouched_bucket(spark, tmp_path):
    store = str(tmp_path / "store")
    scan = spark.range(2000).select(
        F.format_string("/l/%d", "id").alias("path"), F.lit(3).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"),
        content_hash(F.col("id").cast("string")).alias("content_hash"), F.lit(True).alias("readable"),
    )
    first, _, _ = C.apply_scan(empty_catalog(spark), scan, "/l", 1)
    save_catalog(spark, first, store, 1, buckets=64)
    before = stamps(store)
    assert len([p for p in before if "/files/" in p]) == 64

    rows = [(f"/l/{i}", 4, 2, f"new {i}", "changed") for i in range(6)] + [(f"/l/{i}", None, None, None, "removed") for i in range(6, 9)]
    batch = spark.createDataFrame([*rows, ("/l/odd", 0, 2, "", "changed")], CHANGE)
    apply_batch(spark, batch, store, 2)
    after = stamps(store)
    assert {p: after[p] for p in before} == before
    touched = {r[0] for r in batch.select(bucket_of("path", 64)).collect()}
    places = Places.of(spark, store, 2)
    assert {b for b, r in places.runs["files"].items() if r == 2} == touched and len(touched) <= 10
    assert len([r for r in places.runs["items"].values() if r == 2]) <= 15

    # The same state as one scan of everything.
    late = [(f"/l/{i}", 4, 2, f"new {i}") for i in range(6)]
    now = spark.createDataFrame(late, "path string, size long, mtime long, content string")
    now = now.select("path", "size", "mtime", content_hash(F.col("content")).alias("content_hash"), F.lit(True).alias("readable"))
    rest = scan.filter(~F.col("path").isin([r[0] for r in rows]))
    odd = spark.createDataFrame([("/l/odd", 0, 2, None, False)], rest.schema)
    whole, _, _ = C.apply_scan(empty_catalog(spark), rest.unionByName(now).unionByName(odd), "/l", 2)
    stored = load_catalog(spark, store)
    pairs = lambda c: sorted(tuple(r) for r in c.files.select("path", "content_hash", "size", "mtime").collect())
    assert pairs(stored) == pairs(whole)
    assert sorted(r[0] for r in stored.items.select("content_hash").collect()) == sorted(r[0] for r in whole.items.select("content_hash").collect())
    assert [r.path for r in stored.quarantine.collect()] == ["/l/odd"]
    assert load_catalog(spark, store, 1).files.count() == 2000  # older runs stay readable until they are cleaned

    assert clean_runs(spark, store) == len(before) - sum(r == 1 for held in places.runs.values() for r in held.values())
    assert pairs(load_catalog(spark, store)) == pairs(whole) and latest_run(spark, store) == 2


def test_a_bucket_that_loses_its_last_row_is_gone(spark, tmp_path):
    store = str(tmp_path / "store")
    apply_batch(spark, spark.createDataFrame([("/a", 1, 1, "a", "changed")], CHANGE), store, 1)
    apply_batch(spark, spark.createDataFrame([("/a", None, None, None, "removed")], CHANGE), store, 2)
    assert Places.of(spark, store, 2).runs == {"files": {}, "items": {}, "quarantine": {}, "embeddings": {}}
    assert load_catalog(spark, store).files.count() == 0
    # An empty batch is a run that writes no bucket.
    apply_batch(spark, spark.createDataFrame([], CHANGE), store, 3)
    assert latest_run(spark, store) == 3 and load_catalog(spark, store).items.count() == 0


def test_feedback_of_one_user_writes_one_bucket(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, outcome string"
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")

    def deliver(n, rows):
        df = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(f"{folder}/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
        keep_attention(stream, store, str(tmp_path / "cp"), 2, 0, 4, buckets=16).awaitTermination()

    deliver(0, [(i, "2024-01-01 00:00:00", i, "accepted") for i in range(200)])
    before = stamps(store)
    assert len(before) == 16
    deliver(1, [(900, "2024-01-01 01:00:00", 7, "dismissed"), (901, "2024-01-01 02:00:00", 7, "dismissed")])
    after = stamps(store)
    assert {p: after[p] for p in before} == before and len(after) == 17
    got = {r.user_id: r.balance for r in balances(spark, store)[0].collect()}
    assert got == {i: 1 if i == 7 else 3 for i in range(200)}
