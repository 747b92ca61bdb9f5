"""The attention budget kept current from a feedback stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cairnfield.operators.memory import applied, attention_maps
from cairnfield.session import cut_lineage
from cairnfield.sources.buckets import BUCKETS, Places, commit_run, latest_run, read_table, write_table


BALANCES = "user_id bigint, balance bigint"


def balances(spark: SparkSession, store: str) -> tuple[DataFrame, int | None]:
    """Balances of the newest committed batch and its number; an empty table for a new store."""
    newest = latest_run(spark, store)
    return read_table(spark, store, Places.of(spark, store, newest), "balances", BALANCES), newest


def keep_attention(
    stream: DataFrame, store: str, checkpoint: str, start: int, lo: int, hi: int, available_now: bool = True,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Fold each micro-batch of ``event_id, ts, user_id, outcome`` into the stored balances.

    A batch acts on a user's balance through three numbers, so one join per batch carries the state. Only the buckets
    of users with a reaction are read and written; a batch that is already committed is skipped.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = latest_run(spark, store)
        if newest is not None and newest >= batch_id:
            return
        before, after = Places.of(spark, store, newest), Places({}, {})
        # The maps are folded once; there is at most one a user of the batch.
        maps = cut_lineage(attention_maps(batch, lo, hi))
        held = read_table(spark, store, before, "balances", BALANCES, maps.select("user_id"), "user_id")
        moved = applied(held, maps, start)
        write_table(moved, store, before, after, "balances", "user_id", batch_id, maps.select("user_id"), buckets)
        after.store(spark, store, batch_id)
        commit_run(spark, store, batch_id)

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
