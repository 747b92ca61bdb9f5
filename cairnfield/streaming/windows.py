"""Time windows, lateness and duplicate deliveries; every function works on batches and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from cairnfield.functions.time import epoch_micros
from cairnfield.operators.ordered import SLICE, TARGET_ROWS, running, slice_keys


def with_lateness(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time with a watermark; rows later than ``delay`` are dropped by the stateful step that follows.

    Watermarks need a timestamp with zone, so zoneless times are read as UTC here.
    """
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def mark_late(df: DataFrame, ts: str, delay_us: int, arrival: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``late``: whether a row is more than ``delay_us`` behind the latest event time that arrived before it.

    For stored streams, to count what a watermark of that delay drops; ``arrival`` is numeric and unique. Null event
    times are never late.
    """
    placed = df.withColumn("_us", epoch_micros(F.col(ts)))
    sliced = slice_keys(placed, [], F.col(arrival), target_rows)
    upto = running(sliced, [], [arrival], maxima={"_latest": F.col("_us")})
    late = F.coalesce(F.col("_us") < F.col("_latest") - delay_us, F.lit(False))
    return upto.withColumn("late", late).drop("_us", "_latest", SLICE)


class LateRows(StreamingQueryListener):
    """Stores what watermarks of running queries drop: one row per micro-batch that dropped any, below ``path``.

    Add it with ``spark.streams.addListener``. Rows are counted by the stateful steps, so deduplication counts rows and an
    aggregation the groups its tasks made of late rows. Spark judges a batch by the watermark the batch before it ran with,
    so :func:`mark_late` also counts rows one batch behind. A batch that is reported again replaces its row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        done = event.progress
        dropped = sum(step.numRowsDroppedByWatermark for step in done.stateOperators)
        if dropped:
            row = [(str(done.id), done.name, done.batchId, dropped)]
            df = self.spark.createDataFrame(row, "query_id string, name string, batch long, dropped long")
            df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{done.id}/{done.batchId}")


def late_totals(spark: SparkSession, path: str) -> DataFrame:
    """Per query what :class:`LateRows` stored: ``query_id, name, batches, dropped``."""
    stored = spark.read.schema("query_id string, name string, batch long, dropped long").option("recursiveFileLookup", True)
    per_query = stored.parquet(path).groupBy("query_id", "name")
    return per_query.agg(F.count(F.lit(1)).alias("batches"), F.sum("dropped").alias("dropped"))


def count_windows(
    df: DataFrame, size: str, slide: str | None = None, ts: str = "ts", by: Sequence[str] = (), measures: dict[str, Column] | None = None
) -> DataFrame:
    """Counts (and ``measures``) per tumbling window, or per sliding window with ``slide``."""
    frame = F.window(ts, size, slide) if slide else F.window(ts, size)
    extra = [c.alias(n) for n, c in (measures or {}).items()]
    counted = df.groupBy(frame.alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"), *extra)
    names = [n for n in (measures or {})]
    return counted.select(F.col("_w.start").alias("window_start"), *by, "n", *names)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), watermark: tuple[str, str] | None = None) -> DataFrame:
    """One row per ``keys``: on a stream the first within the watermark, on a batch the first by ``order``."""
    if df.isStreaming:
        ts, delay = watermark
        return with_lateness(df, ts, delay).dropDuplicatesWithinWatermark(list(keys))
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)
