"""The incremental ingest job: list, skip what is known, read and hash the rest, embed new content, update all tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.facets import primary_facet
from cairnfield.functions.identity import content_hash
from cairnfield.functions.text import extension
from cairnfield.operators import catalog as C
from cairnfield.operators.embedding import embed_new
from cairnfield.operators.facets import resolve_facets
from cairnfield.operators.segments import SegmentedIndex
from cairnfield.operators.textsearch import TextIndex, build_postings, text_fields
from cairnfield.session import cut_lineage
from cairnfield.sources.catalog_store import latest_run, load_catalog, save_catalog

PATHS_AT_ONCE = 10_000  # files of one read; the driver lists that many, as Spark's own listing does
KEY = "content_hash"


@dataclass(frozen=True)
class Embedder:
    """``fn`` turns one content into ``dim`` numbers or raises; its vectors are tagged with ``model``."""

    model: str
    dim: int
    fn: Callable[[object], object]


def read_files(spark: SparkSession, todo: DataFrame) -> DataFrame:
    """``path, content`` of the listed files only: other files are not opened."""
    found = spark.createDataFrame([], "path string, content binary")
    batch: list[str] = []

    def load(paths: list[str]) -> DataFrame:
        files = spark.read.format("binaryFile").load(paths)
        return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")

    for row in todo.select("path").toLocalIterator():
        batch.append(row["path"])
        if len(batch) == PATHS_AT_ONCE:
            found, batch = found.unionByName(load(batch)), []
    return found.unionByName(load(batch)) if batch else found


def read_from(corpus: DataFrame) -> Callable[[SparkSession, DataFrame], DataFrame]:
    """A reader over a table with ``path, content``."""
    return lambda spark, todo: corpus.select("path", "content").join(todo.select("path"), "path", "left_semi")


def ingest(
    spark: SparkSession,
    listing: DataFrame,
    read: Callable[[SparkSession, DataFrame], DataFrame],
    store: str,
    run: int,
    root: str,
    embedder: Embedder,
    now: Column | None = None,
    max_bytes: int = C.MAX_BYTES,
) -> DataFrame:
    """Bring the store up to a listing (``path, size, mtime``) of ``root`` as run ``run``; the scan report.

    Files with a known stat are not read. Content that is known is not embedded again; content the embedder fails on
    goes to quarantine. Items, embeddings and postings follow, and lose what no file has any more. A run that is
    committed is left alone.
    """
    done = latest_run(spark, store)
    if done is not None and done >= run:
        return spark.read.parquet(f"{store}/run={run}/report")
    catalog = load_catalog(spark, store)
    listing = listing.select("path", "size", "mtime")
    todo = C.needs_read(listing, catalog.files, catalog.quarantine).filter(F.col("size") <= max_bytes)
    fresh = cut_lineage(read(spark, todo).select("path", "content").withColumn(KEY, content_hash(F.col("content"))))

    first = fresh.groupBy(KEY).agg(F.min("path").alias("path"))
    # Contents are parted once for all that follows: embedding, facets and words.
    unknown = cut_lineage(fresh.join(first, [KEY, "path"], "left_semi").join(catalog.items.select(KEY), KEY, "left_anti"))
    vectors, failures = embed_new(unknown, catalog.embeddings, embedder.model, embedder.dim, embedder.fn)
    scan = listing.join(fresh.select("path", KEY), "path", "left").join(failures, KEY, "left")
    # What was not read although it is no larger than the cap was known, or vanished since it was listed.
    scan = scan.withColumn("readable", F.col(KEY).isNotNull() & F.col("error").isNull())
    changes = cut_lineage(C.classify_changes(scan, catalog, max_bytes))
    seen = changes.filter(F.col("outcome").isin(C.INDEXED, C.UPDATED, C.DEDUPED, C.UNCHANGED) | F.col("drops_prior"))
    removed = C.sweep_deleted(catalog.files, seen, root)

    grown = C.Catalog(
        catalog.files, catalog.items, catalog.quarantine, catalog.embeddings.unionByName(vectors), {**catalog.meta, "embed_model": embedder.model}
    )
    after = C.merge_catalog(grown, changes, removed, run)
    described = resolve_facets(unknown).select(
        KEY,
        primary_facet(F.col("facets")).alias("new_facet"),
        extension(F.col("path")).alias("new_format"),
        (now if now is not None else F.current_timestamp()).cast("timestamp_ntz").alias("new_ts"),
    )
    items = after.items.join(described, KEY, "left")
    for name, new in (("facet", "new_facet"), ("format", "new_format"), ("indexed_ts", "new_ts")):
        items = items.withColumn(name, F.coalesce(name, new)).drop(new)
    touched = C.touched_keys(catalog, changes, removed)
    whole = C.Catalog(after.files, items, after.quarantine, after.embeddings, after.meta)
    save_catalog(spark, whole, store, run, commit=False, touched=touched)

    _refresh_text(spark, load_catalog(spark, store, run), unknown, touched["items"], store)
    report = C.scan_report(changes, removed)
    report.write.mode("overwrite").parquet(f"{store}/run={run}/report")
    save_catalog(spark, None, store, run)
    return spark.read.parquet(f"{store}/run={run}/report")


def _refresh_text(spark: SparkSession, saved: C.Catalog, unknown: DataFrame, touched: DataFrame, store: str) -> None:
    """Add postings of file names and folders of new items, and take out those of removed items; a repeat does no harm."""
    added = text_fields(unknown.join(saved.items.select(KEY), KEY, "left_semi").select(KEY, "path"))
    gone = touched.distinct().join(saved.items.select(KEY), KEY, "left_anti")
    SegmentedIndex(spark, f"{store}/text", KEY).refresh(build_postings(added, KEY, ["filename", "text"]), gone)


def stored_index(spark: SparkSession, store: str) -> TextIndex:
    """The text index as it is now."""
    return SegmentedIndex(spark, f"{store}/text", KEY).read()


def search_items(spark: SparkSession, store: str, limit: int = 10, **match) -> DataFrame:
    """The best matches of the stored index as item briefs: key, rank, public id, facet, length and smallest path."""
    from cairnfield.operators.textsearch import search_text

    catalog = load_catalog(spark, store)
    hits = cut_lineage(search_text(stored_index(spark, store), limit, **match))
    # At most ``limit`` hits.
    items = catalog.items.join(F.broadcast(hits), KEY)
    paths = catalog.files.join(F.broadcast(hits.select(KEY)), KEY, "left_semi").groupBy(KEY).agg(F.min("path").alias("path"))
    briefs = items.select(KEY, "rank", "sub_id", "facet", "byte_len").join(paths, KEY, "left")
    return briefs.orderBy("rank", KEY)
