import json
import os
import time

import pytest
from pyspark.sql import functions as F

from cairnfield.functions.identity import content_hash
from cairnfield.operators import catalog as C
from cairnfield.operators.memory import attention_clamped
from cairnfield.sources.catalog_store import empty_catalog, latest_run, load_catalog
from cairnfield.sources.event_log import read_events, write_events
from cairnfield.streaming import debounce as D
from cairnfield.streaming import liveness as A
from cairnfield.streaming import windows as W
from cairnfield.streaming.attention import balances, keep_attention
from cairnfield.streaming.maintenance import apply_batch, backfill_then_follow, dead_letters, maintain_catalog

EVENTS = "event_id long, ts timestamp_ntz, key string, kind string"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def write_batches(spark, folder, *batches, schema=EVENTS):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, ",".join(s.replace("timestamp_ntz", "string") for s in schema.split(",")))
        if "ts timestamp_ntz" in schema:
            df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")


def stream_of(spark, folder, schema=EVENTS, per_batch=1):
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def test_exact_gap_starts_a_new_burst(spark):
    rows = [(1, "2024-01-01 00:00:00", "a", "changed"), (2, "2024-01-01 00:00:00.499999", "a", "removed"),
            (3, "2024-01-01 00:00:00.999999", "a", "changed"), (4, "2024-01-01 00:00:00.1", "b", "changed")]
    df = spark.createDataFrame(rows, "event_id long, ts string, key string, kind string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted((r.key, r.n_events, r.last_kind) for r in D.debounce(df, "key").collect())
    assert got == [("a", 1, "changed"), ("a", 2, "removed"), ("b", 1, "changed")]
    acts = D.resolve_action(D.debounce(df, "key"), "key").groupBy("action").count().collect()
    assert {r.action: r["count"] for r in acts} == {"upsert": 2, "remove": 1}


def test_debounce_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path)
    day = "2024-01-01 00:"
    b0 = [(1, day + "00:00", "a", "changed"), (2, day + "00:10", "a", "removed"), (3, day + "00:05", "b", "changed")]
    b1 = [(4, day + "00:40", "a", "changed"), (5, day + "01:10", "a", "changed")]
    sentinel = [(9, "2024-01-02 00:00:00", "zz", "changed")]
    write_batches(spark, folder, b0, b1, sentinel)
    every = spark.read.schema(EVENTS).option("recursiveFileLookup", True).parquet(folder)
    cols = ["key", "first_ts", "last_ts", "n_events", "last_kind"]
    batch = sorted(map(str, D.debounce(every, "key", 30_000_000).filter("key <> 'zz'").select(cols).collect()))
    live = D.debounce(stream_of(spark, folder, per_batch=10), "key", 30_000_000, watermark="1 minute")
    got = sorted(map(str, drain(live, "bursts").select(cols).collect()))
    assert got == batch


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = ['{"event":"service-up","service":"a","pid":3}', "", "{broken", '{"service":"no tag"}', '{"event":"heartbeat","service":"a","uptime_secs":9}']
    (log / "one.txt").write_text("\n".join(lines))
    good, bad = read_events(spark, str(log))
    assert sorted(r.event for r in good.collect()) == ["heartbeat", "service-up"]
    assert sorted(r.line for r in bad.collect()) == sorted(["{broken", '{"service":"no tag"}'])
    live_good, live_bad = read_events(spark, str(log), streaming=True)
    assert drain(live_good, "good_events").count() == 2
    dead_letters(live_bad, str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    dead = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "dead"))
    assert {(r.line, r.batch) for r in dead.collect()} == {("{broken", 0), ('{"service":"no tag"}', 0)}


def test_wire_shape(spark, tmp_path):
    rows = [("service-down", "x", None), ("service-down", "y", 7)]
    df = spark.createDataFrame(rows, "event string, service string, code int")
    write_events(df, str(tmp_path / "out"), ["service", "code"])
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ['{"event":"service-down","service":"x"}', '{"event":"service-down","service":"y","code":7}']
    good, bad = read_events(spark, str(tmp_path / "out"))
    assert good.count() == 2 and bad.count() == 0
    assert json.loads(lines[1])["code"] == 7


CHANGE = "path string, size long, mtime long, content string, kind string"


def test_streamed_catalog_equals_batch_and_is_idempotent(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    b0 = [("/l/a", 3, 1, "aaa", "changed"), ("/l/b", 3, 1, "aaa", "changed"), ("/l/c", 1, 1, "c", "changed"), ("/l/e", 0, 1, "", "changed")]
    b1 = [("/l/a", 4, 2, "aaaa", "changed"), ("/l/b", 3, 2, "aaa", "removed"), ("/l/d", 1, 2, "c", "changed")]
    write_batches(spark, folder, b0, schema=CHANGE)

    def job(stream, checkpoint, available_now):
        return maintain_catalog(stream, store, checkpoint, available_now=available_now)

    query = backfill_then_follow(lambda: stream_of(spark, folder, CHANGE), job, str(tmp_path / "cp"))
    write_batches(spark, folder + "/later", b1, schema=CHANGE)
    query.processAllAvailable()
    query.stop()
    after = load_catalog(spark, store)
    scan = spark.createDataFrame([("/l/a", 4, 2, "aaaa"), ("/l/c", 1, 1, "c"), ("/l/d", 1, 2, "c"), ("/l/e", 0, 1, "")], "path string, size long, mtime long, content string")
    scan = scan.select("path", "size", "mtime", content_hash(F.col("content")).alias("content_hash"), (F.length("content") > 0).alias("readable"))
    whole, _, _ = C.apply_scan(empty_catalog(spark), scan, "/l", 1)
    pairs = lambda c: sorted((r.path, r.content_hash) for r in c.files.collect())
    assert pairs(after) == pairs(whole)
    assert sorted(r.content_hash for r in after.items.collect()) == sorted(r.content_hash for r in whole.items.collect())
    assert [r.path for r in after.quarantine.collect()] == ["/l/e"]
    run = latest_run(spark, store)
    feed = {(r.path, r.change) for r in spark.read.parquet(f"{store}/run={run}/feed").collect()}
    assert feed == {("/l/a", "updated"), ("/l/b", "removed"), ("/l/d", "indexed")}
    assert spark.read.parquet(f"{store}/run=1/feed").count() == 0  # the cold run is silent
    again = spark.createDataFrame(b1, CHANGE)
    apply_batch(spark, again, store, run)
    assert latest_run(spark, store) == run


def test_removals_without_time_existence_and_unread_files(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [("/l/a", 3, 1, "aaa", "changed"), ("/l/b", 1, 1, "b", "changed"), ("/l/c", 1, 1, "c", "changed"), ("/l/d", 1, 1, "d", "changed")]
    apply_batch(spark, spark.createDataFrame(rows, CHANGE), store, 1)
    gone = [("/l/a", None, None, None, "removed"), ("/l/b", 2, 5, "bb", "changed"), ("/l/b", 2, 5, "bb", "removed"), ("/l/c", 2, 5, "cc", "removed")]
    here = spark.createDataFrame([("/l/c",)], "path string")
    apply_batch(spark, spark.createDataFrame(gone, CHANGE), store, 2)
    assert sorted(r.path for r in load_catalog(spark, store).files.collect()) == ["/l/d"]
    apply_batch(spark, spark.createDataFrame(gone[2:], CHANGE), store, 3, exists=lambda paths: paths.join(here, "path", "left_semi"))
    assert sorted(r.path for r in load_catalog(spark, store).files.collect()) == ["/l/c", "/l/d"]
    scan = spark.createDataFrame([("/l/c", 2, 5, None, True), ("/l/d", 1, 1, None, True)], "path string, size long, mtime long, content_hash string, readable boolean")
    before = load_catalog(spark, store)
    after, changes, _ = C.apply_scan(before, scan, "/l", 4)
    assert {r.outcome for r in changes.collect()} == {"Unchanged"}
    assert sorted(map(str, after.files.collect())) == sorted(map(str, before.files.collect())) and after.items.count() == 2


def test_late_rows_are_counted(spark):
    rows = [(i, f"2024-01-01 {t}") for i, t in enumerate(["10:00:00", "10:05:00", "09:50:00", "09:55:00", "11:00:00", "10:45:00"])] + [(6, None)]
    df = spark.createDataFrame(rows, "n long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for target in (2, 10**6):
        assert {r.n for r in W.mark_late(df, "ts", 600_000_000, "n", target).filter("late").collect()} == {2, 5}


def test_liveness_readiness_and_outages(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", k, e) for i, (s, k, e) in enumerate([(0, "a", "up"), (5, "b", "up"), (12, "a", "beat"), (18, "c", "down"), (20, "c", "down"), (25, "c", "up"), (40, "a", "down")])]
    df = spark.createDataFrame(rows, "event_id long, ts string, key string, kind string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for target in (2, 1000):
        got = {r.event_id: r.alive for r in A.alive(df, "key", 12_000_000, target_rows=target).collect()}
        assert got == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1}
    one = df.withColumn("g", F.lit("all"))
    ready = A.all_seen_at(one, "g", "key", ["a", "b", "c"]).first()
    assert str(ready.ready_ts) == "2024-01-01 00:00:18" and ready.missing == ""
    late = A.all_seen_at(one, "g", "key", ["a", "b", "c", "d"], timeout_us=10_000_000).first()
    assert late.ready_ts is None and late.missing == "c,d"
    for target in (1, 1000):
        outs = {r.key: r.micros_down for r in A.outages(df, "key", F.col("kind") == "down", target_rows=target).collect()}
        assert outs == {"c": 7_000_000, "a": None}


def test_alive_spans_from_a_stream(spark, tmp_path):
    folder = str(tmp_path)
    write_batches(spark, folder, [(1, "2024-01-01 00:00:00", "a", "x"), (2, "2024-01-01 00:00:08", "a", "x"), (3, "2024-01-01 01:00:00", "z", "x")])
    spans = A.alive_spans_stream(stream_of(spark, folder, per_batch=9), "key", "12 seconds", "1 minute")
    got = [(r.key, str(r.up_ts), str(r.down_ts), r.n_events) for r in drain(spans, "alive_spans").collect()]
    assert got == [("a", "2024-01-01 00:00:00", "2024-01-01 00:00:20", 2)]


def test_late_rows_and_duplicates_on_a_stream(spark, tmp_path):
    folder = str(tmp_path)
    write_batches(
        spark,
        folder,
        [(1, "2024-01-01 10:00:00", "a", "x"), (1, "2024-01-01 10:00:00", "a", "x"), (2, "2024-01-01 11:30:00", "a", "x")],
        [(2, "2024-01-01 11:30:00", "a", "x")],
        [(3, "2024-01-01 09:00:00", "a", "x")],
        [(4, "2024-01-01 14:00:00", "a", "x")],
    )
    ordered = stream_of(spark, folder)
    late = W.with_lateness(ordered, "ts", "10 minutes")
    got = {str(r.window_start): r.n for r in drain(W.count_windows(late, "1 hour"), "hourly").collect()}
    assert got == {"2024-01-01 10:00:00": 2, "2024-01-01 11:00:00": 2}  # the 09:00 row came too late
    once = W.dedup(stream_of(spark, folder), ["event_id"], watermark=("ts", "10 minutes"))
    assert sorted(r.event_id for r in drain(once, "once").collect()) == [1, 2, 4]


def test_dropped_rows_of_a_stream_are_stored(spark, tmp_path):
    folder, kept = str(tmp_path / "in"), str(tmp_path / "late")
    # A batch is judged by the watermark that the batch before it ran with, so late rows come two batches after the latest.
    times = ["10:00:00", "10:30:00", "10:31:00", "10:10:00", "11:30:00", "11:31:00", "10:40:00"]
    write_batches(spark, folder, *[[(i, f"2024-01-01 {t}", "a", "x")] for i, t in enumerate(times)])
    listener = W.LateRows(spark, kept)
    spark.streams.addListener(listener)
    try:
        drain(W.dedup(stream_of(spark, folder), ["event_id"], watermark=("ts", "10 minutes")), "late_once")
        every = spark.read.schema(EVENTS).option("recursiveFileLookup", True).parquet(folder)
        late = W.mark_late(every, "ts", 600_000_000, "event_id").filter("late").count()
        assert late == 2
        deadline, found = time.time() + 60, []
        while sum(r.dropped for r in found) < late and time.time() < deadline:
            time.sleep(0.5)
            found = W.late_totals(spark, kept).collect() if os.path.isdir(kept) else []
        assert [(r.name, r.batches, r.dropped) for r in found] == [("late_once", 2, late)]
    finally:
        spark.streams.removeListener(listener)


def test_attention_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "event_id long, ts timestamp_ntz, user_id long, outcome string"
    kinds = ["accepted", "dismissed", "dismissed", "asked", "shown", "dismissed", "accepted"]
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 3, kinds[(i * i) % 7]) for i in range(120)]
    write_batches(spark, folder, rows[:50], rows[50:80], rows[80:], schema=schema)
    store = str(tmp_path / "store")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    keep_attention(stream, store, str(tmp_path / "cp"), 2, 0, 4).awaitTermination()
    got = {r.user_id: r.balance for r in balances(spark, store)[0].collect()}
    every = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    delta = {"accepted": 1, "asked": 1, "dismissed": -1, "shown": 0}
    want = {u: 2 for u in range(3)}
    for _, _, user, kind in rows:
        want[user] = min(4, max(0, want[user] + delta[kind]))
    assert got == want
    for target in (6, 1000):
        assert {r.user_id: r.balance for r in attention_clamped(every, 2, 0, 4, target_rows=target).collect()} == want


@pytest.mark.parametrize("cold", [True, False])
def test_feed_maps_outcomes(spark, cold):
    kinds = ["Indexed", "Updated", "Deduped", "Unchanged", "Failed", "Skipped"]
    df = spark.createDataFrame([(k, f"sha256:{k}", k) for k in kinds], "path string, content_hash string, outcome string")
    got = {r.path: r.change for r in D.change_feed(df, cold=cold).collect()}
    assert got == ({} if cold else {"Indexed": "indexed", "Updated": "updated", "Deduped": "indexed"})
