"""Bursts of changes reduced to one action, and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.identity import public_id
from cairnfield.functions.time import epoch_micros
from cairnfield.operators.ordered import TARGET_ROWS, sessionize
from cairnfield.streaming.windows import with_lateness

# Quiet time in milliseconds, and the feed entry of each outcome.
DEBOUNCE_MS = 500
FEED = {"Indexed": "indexed", "Deduped": "indexed", "Updated": "updated"}


def debounce(
    events: DataFrame,
    key: str,
    gap_us: int = DEBOUNCE_MS * 1000,
    ts: str = "ts",
    kind: str = "kind",
    tie: str = "event_id",
    watermark: str = "10 minutes",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """One row per burst: events of a key less than ``gap_us`` apart, with the last kind seen.

    An event exactly ``gap_us`` after its predecessor starts a new burst. On a stream the session window closes with
    the watermark; its gap is one microsecond shorter because Spark joins events exactly one gap apart.
    """
    last = F.max_by(kind, F.struct(ts, tie)).alias("last_kind")
    if events.isStreaming:
        quiet = F.session_window(ts, f"{gap_us - 1} microseconds")
        grouped = with_lateness(events, ts, watermark).groupBy(key, quiet.alias("_w"))
    else:
        placed = events.withColumn("_us", epoch_micros(F.col(ts)))
        grouped = sessionize(placed, [key], "_us", gap_us, tie, target_rows).groupBy(key, "session_no")
    bursts = grouped.agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"), last
    )
    return bursts.select(key, "first_ts", "last_ts", "n_events", "last_kind")


def resolve_action(bursts: DataFrame, key: str, listing: DataFrame | None = None, removed: str = "removed") -> DataFrame:
    """Add ``action``: upsert or remove. With a ``listing`` of existing keys existence decides, else the last kind."""
    if listing is None:
        return bursts.withColumn("action", F.when(F.col("last_kind") == removed, "remove").otherwise("upsert"))
    present = listing.select(key).distinct().withColumn("_here", F.lit(True))
    joined = bursts.join(present, key, "left")
    return joined.withColumn("action", F.when(F.col("_here"), "upsert").otherwise("remove")).drop("_here")


def change_feed(changes: DataFrame, removed: DataFrame | None = None, cold: bool = False) -> DataFrame:
    """Notifications ``sub_id, content_hash, path, change``; a cold scan, failures and no-ops are silent."""
    mapping = F.create_map(*[F.lit(x) for pair in FEED.items() for x in pair])
    told = changes.select("path", "content_hash", mapping[F.col("outcome")].alias("change"))
    if removed is not None:
        told = told.unionByName(removed.select("path", "content_hash", F.lit("removed").alias("change")))
    told = told.filter(F.col("change").isNotNull() & F.lit(not cold))
    return told.select(public_id(F.col("content_hash")).alias("sub_id"), "content_hash", "path", "change")
