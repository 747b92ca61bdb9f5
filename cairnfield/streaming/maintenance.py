"""Streaming catalog maintenance: every micro-batch is one incremental catalog run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnfield.functions.identity import content_hash
from cairnfield.operators import catalog as C
from cairnfield.sources.catalog_store import latest_run, load_catalog, save_catalog
from cairnfield.streaming.debounce import change_feed


LATEST = (1 << 63) - 1


def apply_batch(spark: SparkSession, batch: DataFrame, store: str, run: int, readable=None, max_bytes: int = C.MAX_BYTES, exists=None) -> None:
    """Fold changed files (``path, size, mtime, content, kind``) into the store as run number ``run``.

    With ``exists``, a function from paths to those that exist now, existence decides over what was last reported. The
    last word about a path counts, by the numeric event time ``ts`` where the batch has it, else by ``mtime``.

    A run that is already committed is left alone, so a repeated batch changes nothing. The classified changes are
    written once and read back, so content is hashed once. Only buckets with changed paths or contents are written.
    """
    done = latest_run(spark, store)
    if done is not None and done >= run:
        return
    catalog = load_catalog(spark, store)
    # A removal has no modification time; among equal times a removal comes last, then the larger hash.
    last = F.struct(F.coalesce("ts" if "ts" in batch.columns else "mtime", F.lit(LATEST)), F.col("kind") == "removed", F.coalesce("mtime", F.lit(LATEST)), F.sha2("content", 256))
    newest = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "content", "kind"), last).alias("_r"))
    newest = newest.select("path", "_r.*")
    if exists is not None:
        here = exists(newest.select("path")).select("path").distinct().withColumn("_here", F.lit(True))
        newest = newest.join(here, "path", "left")
        gone_now = F.col("_here").isNull() | F.col("content").isNull()
        newest = newest.withColumn("kind", F.when(gone_now, "removed").otherwise(F.lit("changed"))).drop("_here")
    present = newest.filter(F.col("kind") != "removed")
    usable = readable if readable is not None else F.length("content") > 0
    scan = present.select(
        "path", "size", "mtime", content_hash(F.col("content")).alias("content_hash"), usable.alias("readable")
    )
    changes_at = f"{store}/run={run}/changes"
    C.classify_changes(scan, catalog, max_bytes).write.mode("overwrite").parquet(changes_at)
    changes = spark.read.parquet(changes_at)
    gone = newest.filter(F.col("kind") == "removed").select("path")
    removed = catalog.files.join(gone, "path", "left_semi")
    # A removed path without a file may still be in quarantine.
    every = gone.join(removed.select("path", "content_hash"), "path", "left")
    after = C.merge_catalog(catalog, changes, every, run, full=False)
    feed = change_feed(changes, removed, cold=done is None)
    feed.write.mode("overwrite").parquet(f"{store}/run={run}/feed")
    save_catalog(spark, after, store, run, touched=C.touched_keys(catalog, changes, every, full=False))


def maintain_catalog(
    stream: DataFrame, store: str, checkpoint: str, readable=None, available_now: bool = False, exists=None
) -> StreamingQuery:
    """Keep the catalog in ``store`` current from a stream of changed files; ``exists`` as in :func:`apply_batch`."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch.sparkSession, batch, store, batch_id + 1, readable, exists=exists)

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def backfill_then_follow(stream_of, job, checkpoint: str) -> StreamingQuery:
    """Drain the backlog first, then go on from the same checkpoint.

    ``stream_of()`` makes the stream; ``job(stream, checkpoint, available_now)`` starts a query over it.
    """
    job(stream_of(), checkpoint, True).awaitTermination()
    return job(stream_of(), checkpoint, False)


def dead_letters(bad: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Store malformed lines beside the number of the batch they came in."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch_no={batch_id}")

    writer = bad.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
