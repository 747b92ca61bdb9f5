"""The ingest job over a folder of files."""

import os

from pyspark.sql import functions as F

from cairnfield.plans import ingest as ingest_job
from cairnfield.plans.ingest import Embedder, ingest, read_files, search_items, stored_index
from cairnfield.sources.catalog_store import load_catalog
from cairnfield.sources.files import scan_corpus


def run(spark, root, store, number, reads):
    def lengths(content):
        if bytes(content).startswith(b"broken"):
            raise ValueError("cannot decode")
        return [float(len(content)), 1.0]

    listing = scan_corpus(spark, root, ["txt"]).select("path", "size", "mtime")

    def read(session, todo):
        reads.append(sorted(os.path.basename(r.path) for r in todo.collect()))
        return read_files(session, todo)

    report = ingest(spark, listing, read, store, number, root, Embedder("m", 2, lengths), F.lit("2024-01-01"))
    return report.first().asDict()


def test_runs_read_only_what_changed(spark, tmp_path):
    root, store, reads = str(tmp_path / "files"), str(tmp_path / "store"), []
    os.makedirs(root)
    for name, text in (("sunny beach.txt", "a b"), ("copy.txt", "a b"), ("desk.txt", "other"), ("bad.txt", "broken")):
        (tmp_path / "files" / name).write_text(text)
    first = run(spark, root, store, 1, reads)
    assert (first["indexed"], first["deduped"], first["failed"]) == (2, 1, 1)
    before = load_catalog(spark, store)
    assert before.items.count() == before.embeddings.count() == 2 and before.meta["embed_model"] == "m"
    assert {r.facet for r in before.items.collect()} and before.items.filter("indexed_ts is null or format <> 'txt'").count() == 0
    assert [os.path.basename(r.path) for r in search_items(spark, store, all=["desk"]).collect()] == ["desk.txt"]

    second = run(spark, root, store, 2, reads)
    assert reads[1] == [] and second["unchanged"] == 3 and second["indexed"] == second["removed"] == 0
    after = load_catalog(spark, store)
    same = lambda df: sorted(map(str, df.collect()))
    assert same(after.files) == same(before.files) and same(after.items) == same(before.items)
    assert same(after.embeddings) == same(before.embeddings) and same(after.quarantine) == same(before.quarantine)

    os.remove(os.path.join(root, "desk.txt"))
    (tmp_path / "files" / "new.txt").write_text("fresh words")
    third = run(spark, root, store, 3, reads)
    assert reads[2] == ["new.txt"] and (third["indexed"], third["removed"]) == (1, 1)
    last = load_catalog(spark, store)
    assert last.items.count() == last.embeddings.count() == 2
    assert search_items(spark, store, all=["desk"]).collect() == []
    assert stored_index(spark, store).lengths.count() == 2
    assert run(spark, root, store, 3, reads) == third and len(reads) == 3


def test_contents_are_parted_once(spark, tmp_path, monkeypatch):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "desk.txt").write_text("other")
    plans = []
    resolve = ingest_job.resolve_facets
    monkeypatch.setattr(ingest_job, "resolve_facets", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or resolve(df))
    assert run(spark, str(tmp_path / "files"), str(tmp_path / "store"), 1, [])["indexed"] == 1
    assert len(plans) == 1 and "Join" not in plans[0]
