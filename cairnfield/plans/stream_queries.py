"""Event-log, session, liveness and window queries; the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.plans import inputs
from cairnfield.plans.catalog_queries import CAP, CHANGES, _run
from cairnfield.plans.registry import query, table
from cairnfield.sources.event_log import event_line, parse_events
from cairnfield.streaming import debounce as D
from cairnfield.streaming import liveness as A
from cairnfield.streaming import windows as W

HALF_HOUR_US = 30 * 60 * 1_000_000
HALF_DAY_US = 12 * 3600 * 1_000_000
KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "event_props_parse",
    """
SELECT event_id, CASE WHEN event_id % 9 = 4 THEN NULL ELSE event_type END AS event,
       CASE WHEN event_id % 9 = 4 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       CASE event_id % 9 WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN 'no type tag' ELSE 'not a valid event' END END AS reason
FROM events WHERE event_id % 9 <> 5""",
)
def event_props_parse(spark, sf):
    """Events as log lines: every ninth is malformed, every ninth blank."""
    ninth = F.col("event_id") % 9
    whole = F.concat(
        F.lit('{"event":"'), "event_type", F.lit('","event_id":'), "event_id", F.lit(',"k":'),
        F.get_json_object("props", "$.k"), F.lit("}"),
    )
    untagged = F.concat(F.lit('{"event_id":'), "event_id", F.lit("}"))
    broken = F.concat(F.lit('{"event":"x","event_id":'), "event_id")
    line = F.when(ninth == 5, "  ").when(ninth != 4, whole).when(F.col("event_id") % 2 == 0, untagged).otherwise(broken)
    good, bad = parse_events(table(spark, sf, "events").select(line.alias("value")), "event string, event_id bigint, k bigint")
    number = F.regexp_extract("line", r'"event_id":([0-9]+)', 1).cast("long")
    rows = bad.select(number.alias("event_id"), "reason")
    return good.unionByName(rows, allowMissingColumns=True)


@query(
    "event_wire_format",
    """
SELECT event_id, '{"event":"' || event_type || '","service":"svc' || user_id || '"'
       || CASE WHEN event_type = 'error' THEN ',"code":' || (event_id % 256) ELSE '' END || '}' AS line FROM events""",
)
def event_wire_format(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("event"),
        F.concat(F.lit("svc"), F.col("user_id").cast("string")).alias("service"),
        F.when(F.col("event_type") == "error", F.col("event_id") % 256).alias("code"),
    )
    return events.select("event_id", event_line("service", "code").alias("line"))


SESSIONS = """
gaps AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM gaps),
bursts AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events,
                  arg_max(event_type, (ts, event_id)) AS last_kind FROM numbered GROUP BY user_id, session)"""


def _bursts(spark, sf):
    return D.debounce(table(spark, sf, "events"), "user_id", HALF_HOUR_US, kind="event_type")


@query("debounce_sessions", f"WITH {SESSIONS} SELECT user_id, first_ts, last_ts, n_events, last_kind FROM bursts")
def debounce_sessions(spark, sf):
    return _bursts(spark, sf)


@query(
    "debounce_resolve",
    f"""
WITH {SESSIONS}, here AS (SELECT DISTINCT o_custkey AS user_id FROM orders)
SELECT b.user_id, last_ts, CASE WHEN last_kind = 'error' THEN 'remove' ELSE 'upsert' END AS by_kind,
       CASE WHEN h.user_id IS NULL THEN 'remove' ELSE 'upsert' END AS by_listing
FROM bursts b LEFT JOIN here h ON h.user_id = b.user_id""",
)
def debounce_resolve(spark, sf):
    """Existence in the current listing (customers with orders) against the last kind seen."""
    listing = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    by_kind = D.resolve_action(_bursts(spark, sf), "user_id", removed="error").withColumnRenamed("action", "by_kind")
    both = D.resolve_action(by_kind, "user_id", listing).withColumnRenamed("action", "by_listing")
    return both.select("user_id", "last_ts", "by_kind", "by_listing")


@query(
    "change_feed",
    f"""
WITH {CHANGES}
SELECT 'sub:item/img_' || substr(content_hash, 8, 12) AS sub_id, content_hash, path,
       CASE outcome WHEN 'Updated' THEN 'updated' ELSE 'indexed' END AS change
FROM changes WHERE outcome IN ('Indexed', 'Deduped', 'Updated')
UNION ALL SELECT 'sub:item/img_' || substr(content_hash, 8, 12), content_hash, path, 'removed' FROM removed""",
)
def change_feed(spark, sf):
    _, changes, removed = _run(spark, sf)
    return D.change_feed(changes, removed)


@query(
    "alive_keys",
    """
SELECT event_id, ts, count(DISTINCT user_id) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS alive
FROM events""",
)
def alive_keys(spark, sf):
    return A.alive(table(spark, sf, "events"), "user_id", HALF_DAY_US)


@query(
    "all_seen_at",
    """
WITH firsts AS (SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN count(*) = 5 THEN max(first_ts) END AS ready_ts,
       coalesce(array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'],
           lambda x: NOT list_contains(list(event_type), x)), ','), '') AS missing
FROM firsts GROUP BY 1""",
)
def all_seen_at(spark, sf):
    return A.all_seen_at(table(spark, sf, "events"), "user_id", "event_type", KINDS)


@query(
    "outage_intervals",
    f"""
WITH {inputs.LIFECYCLE},
turns AS (SELECT *, event = 'service-down' AS down, lag(event = 'service-down') OVER (PARTITION BY service ORDER BY ts, event_id) AS was
  FROM lifecycle),
ends AS (SELECT service, ts AS down_ts, down, lead(ts) OVER (PARTITION BY service ORDER BY ts, event_id) AS up_ts FROM turns
  WHERE down <> coalesce(was, false))
SELECT service, down_ts, up_ts, epoch_us(up_ts) - epoch_us(down_ts) AS micros_down FROM ends WHERE down""",
)
def outage_intervals(spark, sf):
    down = F.col("event") == "service-down"
    return A.outages(inputs.lifecycle(spark, sf), "service", down)


@query(
    "outage_totals",
    f"""
WITH {inputs.LIFECYCLE},
turns AS (SELECT *, event = 'service-down' AS down, lag(event = 'service-down') OVER (PARTITION BY service ORDER BY ts, event_id) AS was
  FROM lifecycle),
ends AS (SELECT service, ts AS down_ts, down, lead(ts) OVER (PARTITION BY service ORDER BY ts, event_id) AS up_ts FROM turns
  WHERE down <> coalesce(was, false))
SELECT service, count(*) AS outages, count(up_ts) AS restarts,
       CAST(sum(epoch_us(up_ts) - epoch_us(down_ts)) AS BIGINT) AS micros_down FROM ends WHERE down GROUP BY 1""",
)
def outage_totals(spark, sf):
    down = F.col("event") == "service-down"
    return A.downtime(A.outages(inputs.lifecycle(spark, sf), "service", down), "service")


@query(
    "tumbling_hourly",
    """
SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
)
def tumbling_hourly(spark, sf):
    return W.count_windows(table(spark, sf, "events"), "1 hour", by=["event_type"])


@query(
    "sliding_hourly",
    """
WITH starts AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS window_start
  FROM events, (SELECT unnest([0, 1, 2, 3]) AS i))
SELECT window_start, count(*) AS n FROM starts GROUP BY 1""",
)
def sliding_hourly(spark, sf):
    return W.count_windows(table(spark, sf, "events"), "1 hour", "15 minutes")


@query(
    "event_dedup",
    """
SELECT event_id, ts, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) = 1""",
)
def event_dedup(spark, sf):
    """The first event of a kind per user and day; everything is delivered twice."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"))
    twice = events.unionByName(events)
    return W.dedup(twice, ["user_id", "event_type", "day"], ["ts", "event_id"]).drop("day")


@query(
    "late_rows",
    """
WITH seen AS (SELECT *, max(ts) OVER (ORDER BY event_id) AS latest FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (ts < latest - INTERVAL 10 MINUTE) AS late FROM seen GROUP BY 1""",
)
def late_rows(spark, sf):
    """What a watermark of ten minutes drops if events arrive by number."""
    marked = W.mark_late(table(spark, sf, "events"), "ts", 600_000_000, "event_id")
    return marked.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))
