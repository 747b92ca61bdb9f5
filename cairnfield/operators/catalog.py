"""Incremental catalog maintenance as set-based table jobs.

A *listing* has ``path, size, mtime``; a *scan* adds ``content_hash`` and ``readable``. The catalog keeps ``files``
(``path, content_hash, size, mtime``), ``items`` (one row per content hash), ``embeddings`` and ``quarantine``
(``path, size, mtime, error, failed_run``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.identity import content_hash, public_id
from cairnfield.functions.text import tokens
from cairnfield.functions.time import camera_epoch
from cairnfield.operators.skew import salted_join
from cairnfield.session import cut_lineage

# Ingest caps.
MAX_BYTES = 256 * 1024 * 1024
MAX_PIXELS = 100_000_000

INDEXED, UPDATED, DEDUPED = "Indexed", "Updated", "Deduped"
UNCHANGED, FAILED, SKIPPED = "Unchanged", "Failed", "Skipped"


@dataclass(frozen=True)
class Catalog:
    """The catalog tables of one run."""

    files: DataFrame
    items: DataFrame
    quarantine: DataFrame
    embeddings: DataFrame | None = None
    meta: dict[str, str] = field(default_factory=dict)


def with_content_id(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``content_hash`` and ``sub_id``."""
    hashed = df.withColumn("content_hash", content_hash(F.col(content)))
    return hashed.withColumn("sub_id", public_id(F.col("content_hash")))


def dedup_items(files: DataFrame) -> DataFrame:
    """One row per content with the number of its paths and the smallest one."""
    return files.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("path").alias("path"), F.max("size").alias("byte_len")
    )


def representative_path(items: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``path``: the lexicographically smallest path of each item, empty when it has none."""
    smallest = files.groupBy("content_hash").agg(F.min("path").alias("_path"))
    joined = items.join(smallest, "content_hash", "left")
    return joined.withColumn("path", F.coalesce("_path", F.lit(""))).drop("_path")


def _stat_of(df: DataFrame, prefix: str, *extra: str) -> DataFrame:
    cols = ["size", "mtime", *extra]
    return df.select("path", *[F.col(c).alias(f"{prefix}{c}") for c in cols], F.lit(True).alias(f"{prefix}seen"))


def _same_stat(prefix: str) -> Column:
    same = (F.col(f"{prefix}size") == F.col("size")) & (F.col(f"{prefix}mtime") == F.col("mtime"))
    return F.coalesce(same, F.lit(False))


def needs_read(listing: DataFrame, files: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The part of a listing whose content has to be read: neither cataloged nor quarantined with the same stat."""
    known = files.select("path", "size", "mtime").unionByName(quarantine.select("path", "size", "mtime"))
    return listing.join(known, ["path", "size", "mtime"], "left_anti")


def classify_changes(scan: DataFrame, catalog: Catalog, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Outcome of every scanned path against the previous catalog.

    ``scan`` has ``path, size, mtime, content_hash, readable``. Content already in the catalog is judged against the
    state before the run; among paths sharing new content the smallest path introduces it.
    """
    # Several passes follow; the content behind the hashes is read once.
    scan = cut_lineage(scan.select("path", "size", "mtime", "content_hash", "readable"))
    prior = _stat_of(catalog.files, "p_", "content_hash")
    held = _stat_of(catalog.quarantine, "q_")
    known = catalog.items.select("content_hash", F.lit(True).alias("_known"))
    staged = (
        scan.join(prior, "path", "left")
        .join(held, "path", "left")
        .withColumn(
            "_early",
            F.when(_same_stat("p_"), UNCHANGED)
            .when(_same_stat("q_"), SKIPPED)
            .when(F.col("size") > max_bytes, FAILED),
        )
    )
    firsts = staged.filter(F.col("_early").isNull() & F.col("readable"))
    firsts = firsts.groupBy("content_hash").agg(F.min("path").alias("_first"))
    by_hash = firsts.join(known, "content_hash", "full")
    judged = salted_join(staged, by_hash, ["content_hash"], "left", spread=["path"])
    had_prior = F.col("p_seen").isNotNull()
    outcome = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_known") & (F.col("p_content_hash") == F.col("content_hash")), UNCHANGED)
        .when(~F.col("readable") & F.col("_known").isNull(), FAILED)
        .when(had_prior, UPDATED)
        .when(F.col("_known"), DEDUPED)
        .when(F.col("path") == F.col("_first"), INDEXED)
        .otherwise(DEDUPED)
    )
    error = F.when(F.col("size") > max_bytes, "too large").otherwise("unreadable")
    same_hash = F.coalesce(F.coalesce("content_hash", "p_content_hash") == F.col("p_content_hash"), F.lit(True))
    return judged.select(
        "path",
        "size",
        "mtime",
        # Files that were not read again keep what the catalog knows of them.
        F.when(F.col("_early").isNotNull(), F.coalesce("content_hash", "p_content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.col("p_content_hash").alias("prior_hash"),
        outcome.alias("outcome"),
        F.when(outcome == FAILED, error).alias("error"),
        # A failed read of new content loses its old mapping at once; an oversized file only with the next sweep.
        ((outcome == FAILED) & had_prior & (F.col("size") <= max_bytes)).alias("drops_prior"),
        # Nothing the catalog stores about the path differs.
        ((_same_stat("p_") & same_hash) | _same_stat("q_")).alias("as_stored"),
    )


def under_root(path: Column, root: str) -> Column:
    """Literal containment: the root itself or anything below it; a trailing slash of the root is ignored."""
    base = root.rstrip("/")
    return (path == base) | path.startswith(base + "/")


def sweep_deleted(files: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """Cataloged files under ``root`` that the current run did not see."""
    return files.filter(under_root(F.col("path"), root)).join(seen.select("path"), "path", "left_anti")


def gc_orphans(items: DataFrame, files: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """Items that still have a file, followed by each child table reduced to those items."""
    live = files.select("content_hash").distinct()
    kept = items.join(live, "content_hash", "left_semi")
    return (kept, *[salted_join(child, live, ["content_hash"], "left_semi") for child in children])


def orphans(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items without any file."""
    return items.join(files.select("content_hash").distinct(), "content_hash", "left_anti")


def merge_quarantine(old: DataFrame, failures: DataFrame, listing: DataFrame, full: bool = True) -> DataFrame:
    """Quarantine after a run: new failures win, unchanged files stay, retried or vanished files leave.

    ``old`` and ``failures`` have ``path, size, mtime, error, failed_run``. Unless the listing is ``full``, entries it
    does not mention stay as well.
    """
    stat = listing.select("path", "size", "mtime")
    staying = old.join(stat, ["path", "size", "mtime"], "left_semi")
    if not full:
        staying = staying.unionByName(old.join(stat, "path", "left_anti"))
    entries = staying.unionByName(failures).withColumn("_e", F.struct("size", "mtime", "error", "failed_run"))
    latest = entries.groupBy("path").agg(F.max_by("_e", "failed_run").alias("_e"))
    return latest.select("path", "_e.*")


def split_by_size(
    df: DataFrame, max_bytes: int = MAX_BYTES, max_pixels: int = MAX_PIXELS
) -> tuple[DataFrame, DataFrame]:
    """Rows within the caps, and the rest with an ``error``; ``width``/``height`` are checked when present."""
    big = F.coalesce(F.col("size") > max_bytes, F.lit(False))
    wide = F.lit(False)
    if {"width", "height"} <= set(df.columns):
        pixels = F.col("width").cast("long") * F.col("height").cast("long")
        wide = F.coalesce(pixels > max_pixels, F.lit(False))
    reason = F.when(big, "byte cap").when(wide, "pixel cap")
    return df.filter(~big & ~wide), df.filter(big | wide).withColumn("error", reason)


def scan_report(changes: DataFrame, removed: DataFrame) -> DataFrame:
    """Counts per outcome of one run; skipped files are not counted."""
    names = [INDEXED, UPDATED, DEDUPED, UNCHANGED, FAILED]
    per_outcome = changes.select(F.lower("outcome").alias("outcome")).filter(F.col("outcome") != "skipped")
    everything = per_outcome.unionByName(removed.select(F.lit("removed").alias("outcome")))
    return everything.groupBy().agg(
        *[F.count_if(F.col("outcome") == n.lower()).alias(n.lower()) for n in [*names, "Removed"]]
    )


def catalog_stats(catalog: Catalog) -> DataFrame:
    """One row: number of items, files, embeddings and quarantined files, with the catalog's own settings."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")

    parts = {"items": catalog.items, "files": catalog.files, "failed": catalog.quarantine}
    if catalog.embeddings is not None:
        parts["embeddings"] = catalog.embeddings
    stacked = None
    for name, df in parts.items():
        row = counted(df, name)
        stacked = row if stacked is None else stacked.unionByName(row)
    row = stacked.groupBy().agg(*[F.max(F.when(F.col("part") == n, F.col("n"))).alias(n) for n in parts])
    for key, value in sorted(catalog.meta.items()):
        row = row.withColumn(key, F.lit(value))
    return row


def list_items(items: DataFrame, files: DataFrame, limit: int = 50) -> DataFrame:
    """The most recently indexed items with their representative path."""
    recent = items.orderBy(F.desc("indexed_ts"), F.desc("content_hash")).limit(limit)
    # At most ``limit`` rows on the broadcast sides.
    mine = files.join(F.broadcast(recent.select("content_hash")), "content_hash", "left_semi")
    paths = mine.groupBy("content_hash").agg(F.min("path").alias("_path"))
    hydrated = recent.join(F.broadcast(paths), "content_hash", "left")
    hydrated = hydrated.withColumn("path", F.coalesce("_path", F.lit(""))).drop("_path")
    return hydrated.orderBy(F.desc("indexed_ts"), F.desc("content_hash"))


def item_for_path(files: DataFrame, items: DataFrame, paths: DataFrame) -> DataFrame:
    """Items behind the given ``path`` values; unknown paths give no row."""
    return files.join(paths.select("path"), "path").select("path", "content_hash").join(items, "content_hash")


def merge_catalog(catalog: Catalog, changes: DataFrame, removed: DataFrame, run: int, full: bool = True) -> Catalog:
    """The next catalog: replace by path, add new content once, drop what was swept and what lost its last file.

    ``full`` says that the changes cover every file; a partial run leaves unmentioned quarantine entries alone.
    """
    placed = changes.filter(F.col("outcome").isin(INDEXED, UPDATED, DEDUPED, UNCHANGED))
    placed = placed.select("path", "content_hash", "size", "mtime")
    gone = removed.select("path").unionByName(changes.filter("drops_prior").select("path"))
    untouched = catalog.files.join(placed.select("path").unionByName(gone), "path", "left_anti")
    files = untouched.select("path", "content_hash", "size", "mtime").unionByName(placed)
    fresh = placed.groupBy("content_hash").agg(F.max("size").alias("byte_len"))
    fresh = fresh.join(catalog.items.select("content_hash"), "content_hash", "left_anti")
    fresh = fresh.withColumn("sub_id", public_id(F.col("content_hash"))).withColumn("first_run", F.lit(run).cast("long"))
    items = catalog.items.unionByName(fresh, allowMissingColumns=True)
    failures = changes.filter(F.col("outcome") == FAILED)
    failures = failures.select("path", "size", "mtime", "error", F.lit(run).cast("long").alias("failed_run"))
    held = catalog.quarantine
    if not full:
        held = held.join(removed.select("path"), "path", "left_anti")
    quarantine = merge_quarantine(held, failures, changes, full)
    if catalog.embeddings is None:
        (items,) = gc_orphans(items, files)
        return Catalog(files, items, quarantine, None, catalog.meta)
    items, embeddings = gc_orphans(items, files, catalog.embeddings)
    return Catalog(files, items, quarantine, embeddings, catalog.meta)


def touched_keys(catalog: Catalog, changes: DataFrame, removed: DataFrame, full: bool = True) -> dict[str, DataFrame]:
    """Keys per table whose rows :func:`merge_catalog` may add, alter or drop; all others stay as they are.

    ``changes`` come from :func:`classify_changes`; ``removed`` has ``path, content_hash``.
    """
    differ = changes.filter(~F.col("as_stored"))
    paths = differ.select("path").unionByName(removed.select("path"))
    hashes = F.explode(F.array_compact(F.array("content_hash", "prior_hash"))).alias("content_hash")
    contents = differ.select(hashes).unionByName(removed.select("content_hash").dropna())
    held = paths
    if full:
        held = paths.unionByName(catalog.quarantine.join(changes, "path", "left_anti").select("path"))
    return {"files": paths, "items": contents, "quarantine": held, "embeddings": contents}


def apply_scan(
    catalog: Catalog, scan: DataFrame, root: str, run: int, max_bytes: int = MAX_BYTES
) -> tuple[Catalog, DataFrame, DataFrame]:
    """One full scan of ``root``: the next catalog, the classified changes and the swept paths."""
    # The changes feed five results; the scan is hashed and classified once.
    changes = cut_lineage(classify_changes(scan, catalog, max_bytes))
    seen = changes.filter(F.col("outcome").isin(INDEXED, UPDATED, DEDUPED, UNCHANGED) | F.col("drops_prior"))
    removed = sweep_deleted(catalog.files, seen, root)
    return merge_catalog(catalog, changes, removed, run), changes, removed


def detect_moves(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Content whose paths changed between snapshots: how many paths left and came, and the smallest of each.

    A content that lost and gained paths has moved; paths are matched in counts, never paired one by one, so any
    number of copies stays linear.
    """
    gone = prev.join(cur.select("path"), "path", "left_anti")
    came = cur.join(prev.select("path"), "path", "left_anti")
    out = gone.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_removed"), F.min("path").alias("from_path"))
    into = came.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_added"), F.min("path").alias("to_path"))
    return out.join(into, "content_hash")


def capture_times(df: DataFrame, stamp: str, *labels: str) -> DataFrame:
    """Add ``capture_ts`` (epoch seconds) from camera text and trim label columns, empty becoming null."""
    cleaned = {c: F.nullif(F.trim(c), F.lit("")) for c in labels}
    return df.withColumns({"capture_ts": camera_epoch(F.col(stamp)), **cleaned})


def resolve_address(
    catalog: DataFrame,
    facet: str | None = None,
    time_range: tuple[str, str] | None = None,
    entity: str | None = None,
    text: str | None = None,
    k: int = 10,
) -> DataFrame:
    """Ranked candidates for a description; every given facet, time range and entity must hold.

    ``catalog`` has ``path, facets array<string>, ts, entities array<string>, terms array<string>``. Words of
    ``text`` are evidence: candidates are ordered by how many of them they contain.
    """
    found = catalog
    if facet is not None:
        found = found.filter(F.array_contains("facets", facet))
    if time_range is not None:
        lo, hi = (F.lit(t).cast("timestamp_ntz") for t in time_range)
        found = found.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    if entity is not None:
        found = found.filter(F.array_contains("entities", entity))
    evidence = F.lit(0)
    if text is not None:
        evidence = F.size(F.array_intersect(F.col("terms"), F.array_distinct(tokens(F.lit(text)))))
    scored = found.withColumn("evidence", evidence.cast("long"))
    if text is not None:
        scored = scored.filter(F.col("evidence") > 0)
    return scored.orderBy(F.desc("evidence"), "path").limit(k)


def snapshot_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Paths of two snapshots with ``change``: added, removed or common."""
    old, new = prev.select("path"), cur.select("path")
    return (
        new.exceptAll(old)
        .withColumn("change", F.lit("added"))
        .unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))
        .unionByName(old.intersect(new).withColumn("change", F.lit("common")))
    )
