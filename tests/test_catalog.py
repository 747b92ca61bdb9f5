import pytest
from pyspark.sql import functions as F

from cairnfield.operators import catalog as C
from cairnfield.sources.catalog_store import empty_catalog, latest_run, load_catalog, save_catalog

SCAN = "path string, size long, mtime long, content_hash string, readable boolean"


def scan(spark, *rows):
    return spark.createDataFrame([(p, s, m, h, ok) for p, s, m, h, ok in rows], SCAN)


def outcomes(changes):
    return {r.path: r.outcome for r in changes.collect()}


@pytest.fixture()
def first(spark):
    rows = [("/a/1", 5, 1, "h1", True), ("/a/2", 5, 1, "h1", True), ("/a/3", 7, 1, "h3", True), ("/a/bad", 4, 1, "hx", False)]
    catalog, changes, removed = C.apply_scan(empty_catalog(spark), scan(spark, *rows), "/a/", 1)
    return catalog, changes, removed


def test_first_scan(first):
    catalog, changes, removed = first
    assert outcomes(changes) == {"/a/1": "Indexed", "/a/2": "Deduped", "/a/3": "Indexed", "/a/bad": "Failed"}
    assert removed.count() == 0
    assert sorted(r.content_hash for r in catalog.items.collect()) == ["h1", "h3"]
    assert catalog.files.count() == 3
    assert [r.path for r in catalog.quarantine.collect()] == ["/a/bad"]


def test_rescan_is_a_no_op(spark, first):
    catalog, _, _ = first
    rows = [("/a/1", 5, 1, "h1", True), ("/a/2", 5, 1, "h1", True), ("/a/3", 7, 1, "h3", True), ("/a/bad", 4, 1, "hx", False)]
    after, changes, removed = C.apply_scan(catalog, scan(spark, *rows), "/a", 2)
    assert set(outcomes(changes).values()) == {"Unchanged", "Skipped"}
    assert removed.count() == 0
    report = C.scan_report(changes, removed).first().asDict()
    assert report == {"indexed": 0, "updated": 0, "deduped": 0, "unchanged": 3, "failed": 0, "removed": 0}
    assert after.items.count() == 2 and after.quarantine.count() == 1


def test_touch_update_move_delete_and_garbage(spark, first):
    catalog, _, _ = first
    rows = [
        ("/a/1", 5, 2, "h1", True),  # touched only
        ("/a/moved", 7, 1, "h3", True),  # was /a/3
        ("/a/2", 6, 3, "garbage", False),  # modified into garbage
        ("/a/bad", 9, 5, "h9", True),  # repaired
    ]
    after, changes, removed = C.apply_scan(catalog, scan(spark, *rows), "/a/", 2)
    assert outcomes(changes) == {"/a/1": "Unchanged", "/a/moved": "Deduped", "/a/2": "Failed", "/a/bad": "Indexed"}
    assert [r.path for r in removed.collect()] == ["/a/3"]
    assert {r.path: r.content_hash for r in after.files.collect()} == {"/a/1": "h1", "/a/moved": "h3", "/a/bad": "h9"}
    assert [(r.path, r.failed_run) for r in after.quarantine.collect()] == [("/a/2", 2)]
    moves = C.detect_moves(catalog.files, after.files).collect()
    assert [(m.from_path, m.to_path) for m in moves] == [("/a/3", "/a/moved")]


def test_oversized_file_loses_its_mapping_with_the_sweep(spark, first):
    catalog, _, _ = first
    rows = [("/a/1", 500, 2, None, True), ("/a/2", 5, 1, "h1", True), ("/a/3", 7, 1, "h3", True)]
    after, changes, removed = C.apply_scan(catalog, scan(spark, *rows), "/a", 2, max_bytes=100)
    assert outcomes(changes)["/a/1"] == "Failed"
    assert [r.path for r in removed.collect()] == ["/a/1"]
    assert after.items.count() == 2


def test_root_is_a_literal_prefix(spark):
    files = spark.createDataFrame([("/a_b/x", "h"), ("/axb/x", "h"), ("/a_b", "h"), ("/a_bc/y", "h")], "path string, content_hash string")
    seen = spark.createDataFrame([], "path string")
    assert sorted(r.path for r in C.sweep_deleted(files, seen, "/a_b/").collect()) == ["/a_b", "/a_b/x"]


def test_quarantine_last_failure_wins(spark):
    schema = "path string, size long, mtime long, error string, failed_run long"
    old = spark.createDataFrame([("p", 1, 1, "old", 1), ("gone", 1, 1, "old", 1), ("fixed", 1, 1, "old", 1)], schema)
    new = spark.createDataFrame([("p", 1, 1, "new", 2)], schema)
    listing = spark.createDataFrame([("p", 1, 1), ("fixed", 2, 2)], "path string, size long, mtime long")
    assert [(r.path, r.error) for r in C.merge_quarantine(old, new, listing).collect()] == [("p", "new")]


def test_capture_times(spark):
    stamps = {"2021:01:01 00:00:00": 1609459200, "2020:02:29 00:00:00": 1582934400, "2021:13:01 00:00:00": None,
              "2021:02:31 00:00:00": 1614729600, "nonsense": None, "2021:01:32 00:00:00": None}
    df = spark.createDataFrame([(s, "  Canon ", " ") for s in stamps], "stamp string, make string, model string")
    got = {r.stamp: r for r in C.capture_times(df, "stamp", "make", "model").collect()}
    assert {s: r.capture_ts for s, r in got.items()} == stamps
    assert got["nonsense"].make == "Canon" and got["nonsense"].model is None


def test_pixel_cap(spark):
    df = spark.createDataFrame([("a", 1, 10, 10), ("b", 1, 30_000, 30_000), ("c", 1, None, None)], "p string, size long, width int, height int")
    ok, bad = C.split_by_size(df)
    assert [(r.p, r.error) for r in bad.collect()] == [("b", "pixel cap")] and ok.count() == 2


def test_store_round_trip(spark, first, tmp_path):
    catalog, _, _ = first
    store = str(tmp_path)
    assert latest_run(spark, store) is None
    save_catalog(spark, catalog, store, 1)
    again = load_catalog(spark, store)
    assert latest_run(spark, store) == 1
    assert sorted(map(str, again.files.collect())) == sorted(map(str, catalog.files.select("path", "content_hash", "size", "mtime").collect()))
    save_catalog(spark, C.Catalog(again.files.limit(0), again.items, again.quarantine), f"{store}", 2)
    assert load_catalog(spark, store).files.count() == 0 and latest_run(spark, store) == 2


def test_address_returns_candidates(spark):
    rows = [("/x", ["pdf"], ["acme"], ["invoice", "march"]), ("/y", ["pdf"], ["acme"], ["invoice"]), ("/z", ["image"], [], ["invoice"])]
    df = spark.createDataFrame(rows, "path string, facets array<string>, entities array<string>, terms array<string>")
    df = df.withColumn("ts", F.lit("2024-03-05").cast("timestamp_ntz"))
    got = C.resolve_address(df, "pdf", ("2024-03-01", "2024-04-01"), "acme", "Invoice March")
    assert [(r.path, r.evidence) for r in got.collect()] == [("/x", 2), ("/y", 1)]


def test_metadata_only_plan(spark, sf):
    from cairnfield.plans.catalog_queries import stat_cache_misses

    plan = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[-1]
    assert stat_cache_misses(spark, sf).count() > 0
