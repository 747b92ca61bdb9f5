"""Who is alive, when everybody was up, and outages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.time import epoch_micros
from cairnfield.operators.ordered import SLICE, TARGET_ROWS, neighbours, running, sessionize, slice_keys
from cairnfield.streaming.windows import with_lateness

# Liveness horizon and readiness timeout in seconds.
ALIVE_SECONDS = 12
READY_SECONDS = 30


def alive_spans(
    events: DataFrame, key: str, horizon_us: int, tie: str = "event_id", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Spans of uninterrupted life per key: ``key, up_us, down_us``; a key lives ``horizon_us`` past each event."""
    placed = events.select(key, tie, epoch_micros(F.col("ts")).alias("_us"))
    grouped = sessionize(placed, [key], "_us", horizon_us + 1, tie, target_rows).groupBy(key, "session_no")
    spans = grouped.agg(F.min("_us").alias("up_us"), (F.max("_us") + horizon_us).alias("down_us"))
    return spans.drop("session_no")


def alive_spans_stream(events: DataFrame, key: str, horizon: str, watermark: str) -> DataFrame:
    """The same spans from a stream, each emitted once the watermark has passed its end."""
    seen = F.session_window("ts", horizon).alias("_w")
    spans = with_lateness(events, "ts", watermark).groupBy(key, seen).agg(F.count(F.lit(1)).alias("n_events"))
    return spans.select(key, F.col("_w.start").alias("up_ts"), F.col("_w.end").alias("down_ts"), "n_events")


def alive(
    events: DataFrame, key: str, horizon_us: int = ALIVE_SECONDS * 1_000_000, tie: str = "event_id",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Each event with ``alive``: how many keys were seen within the horizon, the event itself included.

    Keys become +1 / -1 steps at the ends of their spans; a running total over the steps gives the count, so no
    window has to hold the keys of a whole horizon.
    """
    spans = alive_spans(events, key, horizon_us, tie, target_rows)
    ends = F.array(
        F.struct(F.col("up_us").alias("_us"), F.lit(1).cast("long").alias("_d")),
        F.struct((F.col("down_us") + 1).alias("_us"), F.lit(-1).cast("long").alias("_d")),
    )
    steps = spans.select(F.inline_outer(ends), F.col(key).cast("string").alias("_t"), F.lit(0).alias("_o"))
    points = events.select(
        tie,
        "ts",
        epoch_micros(F.col("ts")).alias("_us"),
        F.lit(0).cast("long").alias("_d"),
        F.col(tie).cast("string").alias("_t"),
        F.lit(1).alias("_o"),
    )
    line = points.unionByName(steps, allowMissingColumns=True)
    sliced = slice_keys(line, [], F.col("_us"), target_rows)
    counted = running(sliced, [], ["_us", "_o", "_d", "_t"], sums={"alive": F.col("_d")})
    return counted.filter(F.col("_o") == 1).select(tie, "ts", "alive")


def all_seen_at(events: DataFrame, group: str, key: str, expected: Sequence[str], timeout_us: int | None = None) -> DataFrame:
    """Per group when the last expected key was first seen (``ready_ts``), or the ``missing`` ones.

    With ``timeout_us`` keys that came later than that after the group's first event count as missing.
    """
    firsts = events.filter(F.col(key).isin(*expected)).groupBy(group, key).agg(F.min("ts").alias("_first"))
    begun = events.groupBy(group).agg(F.min("ts").alias("_begin"))
    firsts = firsts.join(begun, group)
    if timeout_us is not None:
        firsts = firsts.withColumn("_ok", epoch_micros(F.col("_first")) - epoch_micros(F.col("_begin")) <= timeout_us)
    else:
        firsts = firsts.withColumn("_ok", F.lit(True))
    # At most one row per expected key and group.
    seen = firsts.groupBy(group).agg(
        F.collect_set(F.when(F.col("_ok"), F.col(key))).alias("_seen"), F.max(F.when(F.col("_ok"), F.col("_first"))).alias("_last")
    )
    everyone = begun.join(seen, group, "left")
    wanted = F.array(*[F.lit(e) for e in expected])
    missing = F.array_sort(F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))))
    ready = F.when(F.size(missing) == 0, F.col("_last"))
    return everyone.select(group, ready.alias("ready_ts"), F.array_join(missing, ",").alias("missing"))


def outages(
    events: DataFrame, key: str, is_down: Column, ts: str = "ts", tie: str = "event_id", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """One row per outage: from the first down event to the next other event of the key (null while it lasts)."""
    placed = events.select(key, ts, tie, epoch_micros(F.col(ts)).alias("_us"), is_down.cast("int").alias("_down"))
    sliced = slice_keys(placed, [key], F.col("_us"), target_rows)
    order = ["_us", tie]
    linked = neighbours(sliced, [key], order, back={"_was": ("_down", 1)})
    turns = linked.filter(F.col("_down") != F.coalesce("_was", F.lit(0))).drop("_was")
    ended = neighbours(turns, [key], order, ahead={"up_ts": (ts, 1)})
    found = ended.filter(F.col("_down") == 1).drop(SLICE)
    micros = epoch_micros(F.col("up_ts")) - F.col("_us")
    return found.select(key, F.col(ts).alias("down_ts"), "up_ts", micros.alias("micros_down"))


def downtime(outage_rows: DataFrame, key: str) -> DataFrame:
    """Per key: outages, restarts and total microseconds down."""
    return outage_rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("outages"), F.count("up_ts").alias("restarts"), F.sum("micros_down").alias("micros_down")
    )
