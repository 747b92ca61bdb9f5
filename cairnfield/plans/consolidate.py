"""The nightly job: catalog, graph, habits and memory of one run, with a log of what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import catalog as C
from cairnfield.operators import graph as G
from cairnfield.operators import habits as H
from cairnfield.operators import memory as K
from cairnfield.session import cut_lineage
from cairnfield.sources.catalog_store import latest_run, load_catalog, save_catalog

DAY_SECONDS = 86_400.0
CLUSTER_GAP_US = 6 * 60 * 1_000_000
CLUSTER_RADIUS = 0.9
LOG_SCHEMA = "run bigint, step string, n bigint, n_before bigint"


@dataclass(frozen=True)
class Inputs:
    """A scan of the corpus (``path, size, mtime, content_hash, readable``) and the event log."""

    scan: DataFrame
    events: DataFrame
    root: str
    now: Column
    vectors: DataFrame | None = None  # ``model, item_id, capture_ts, vec``, for capture clusters


def _steps(inputs: Inputs) -> dict[str, DataFrame]:
    events = inputs.events
    acted = events.withColumn("act", F.concat(F.lit("act:"), "event_type"))
    used = G.build_edges(acted, G.to_nodes("user:", "user_id"), F.col("act"), "used-with")
    edges = G.decay(used.unionByName(G.followed_by(acted, "user_id", "act")), 7 * DAY_SECONDS, 0.05, inputs.now)
    threads = K.salience(events, "user_id", "event_type", 3 * DAY_SECONDS, inputs.now)
    kept, evicted = K.retain_salient(threads.withColumnRenamed("event_type", "thread"), 3)
    tail = H.k_of_last_n(events, F.col("event_type") == "purchase", 5)
    daily = events.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    steps = cut_lineage(edges.select("src", "dst"))
    active = kept.select(F.concat(F.lit("act:"), "thread").alias("node")).distinct()
    clusters = {} if inputs.vectors is None else {"clusters": G.capture_clusters(inputs.vectors, CLUSTER_GAP_US, CLUSTER_RADIUS)}
    return {
        "habits_given": H.next_actions_given(events, 2),
        "trends": H.runs_of_increase(daily, "user_id", F.col("day"), "n", "day", 3),
        "reach": G.k_hop(steps, active, 2),
        **clusters,
        "edges": edges,
        "habits": H.next_actions(events, tau_seconds=7 * DAY_SECONDS),
        "hypotheses": tail.filter(F.col("hits") >= 3),
        "slots": H.recurring_slots(events),
        "threads": kept.drop("rank"),
        "evicted": evicted,
    }


def consolidate(spark: SparkSession, inputs: Inputs, store: str, run: int) -> DataFrame:
    """Run every step, write its table below ``store`` and return the log.

    Each step is written before the next begins, so a lost executor costs its tasks only, and a repeated run number
    overwrites itself.
    """
    before_run = latest_run(spark, f"{store}/catalog")
    catalog = load_catalog(spark, f"{store}/catalog")
    if before_run is None or before_run < run:
        after, changes, removed = C.apply_scan(catalog, inputs.scan, inputs.root, run)
        C.scan_report(changes, removed).write.mode("overwrite").parquet(f"{store}/insight/run={run}/report")
        save_catalog(spark, after, f"{store}/catalog", run, touched=C.touched_keys(catalog, changes, removed))
    log = [(run, "items", load_catalog(spark, f"{store}/catalog").items.count(), catalog.items.count())]
    for name, df in _steps(inputs).items():
        target = f"{store}/insight/run={run}/{name}"
        df.write.mode("overwrite").parquet(target)
        earlier = spark.read.parquet(f"{store}/insight/run={before_run}/{name}").count() if before_run and before_run < run else 0
        log.append((run, name, spark.read.parquet(target).count(), earlier))
    entries = spark.createDataFrame(log, LOG_SCHEMA)
    entries.write.mode("overwrite").parquet(f"{store}/insight/run={run}/log")
    return entries
