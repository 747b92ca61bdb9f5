"""Inputs the queries share, derived from the base tables, each as a DataFrame and as a SQL common table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.plans.registry import table

# Row counts of the two catalog snapshots differ by rule: of every ten documents one is new, one edited, one moved,
# one only touched and one gone.
CORPUS_PREV = """
corpus_prev AS (
  SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text AS content,
         length(text) AS size, CAST(1700000000 + doc_id AS BIGINT) AS mtime
  FROM documents WHERE doc_id % 10 <> 1)"""

CORPUS_CUR = """
corpus_cur AS (
  SELECT CASE WHEN doc_id % 10 = 5 THEN '/lib/moved/' ELSE '/lib/' || source || '/' END
         || CAST(doc_id AS VARCHAR) || '.txt' AS path,
         CASE WHEN doc_id % 10 = 3 THEN text || ' v2' ELSE text END AS content,
         length(CASE WHEN doc_id % 10 = 3 THEN text || ' v2' ELSE text END) AS size,
         CAST(1700000000 + doc_id + CASE WHEN doc_id % 10 IN (3, 7) THEN 1 ELSE 0 END AS BIGINT) AS mtime
  FROM documents WHERE doc_id % 10 <> 9)"""

VECTORS = """
vectors AS (
  SELECT v.vec_id AS item_id, 'item-' || CAST(v.vec_id AS VARCHAR) AS content_hash,
         CASE WHEN v.vec_id % 10 = 9 THEN 'model-b' ELSE 'model-a' END AS model,
         CAST(v.embedding AS DOUBLE[]) AS vec, v.label AS label,
         CASE WHEN v.vec_id % 7 = 0 THEN NULL ELSE e.ts END AS capture_ts
  FROM embeddings v LEFT JOIN events e ON e.event_id = v.vec_id)"""

ROUTE_INPUTS = """
route_inputs AS (
  SELECT d.doc_id AS doc_id, CAST(d.doc_id % 100 AS DOUBLE) / 100 AS local_confidence,
         CAST((d.doc_id * 7) % 100 AS DOUBLE) / 100 AS complexity,
         coalesce(l.toxic, 0) = 1 AS sensitive, d.doc_id % 13 <> 0 AS online,
         CASE d.doc_id % 3 WHEN 0 THEN 'airgapped' WHEN 1 THEN 'balanced' ELSE 'cloud-boosted' END AS dial
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

JOURNAL_BATCH = """
journal_batch AS (
  SELECT event_id AS ord, ts, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'agent' END AS actor,
         'cap.' || event_type AS capability, user_id AS subject,
         CASE WHEN event_type = 'purchase' THEN 'irreversible' ELSE 'undoable' END AS kind,
         CASE WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN event_id - 1 END AS consent_seq,
         CASE WHEN event_type <> 'purchase'
              THEN '{"op":"restore","target":' || CAST(event_id AS VARCHAR) || '}' END AS inverse,
         CASE event_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'remote-a' WHEN 2 THEN 'remote-b' END AS engine
  FROM events)"""

JOURNAL = f"""{JOURNAL_BATCH},
journal AS (
  SELECT row_number() OVER (ORDER BY ord) - 1 AS seq, * FROM journal_batch
  WHERE NOT (kind = 'irreversible' AND consent_seq IS NULL))"""

LIFECYCLE = """
lifecycle AS (
  SELECT event_id, ts, 'svc' || CAST(user_id AS VARCHAR) AS service,
         CASE event_type WHEN 'error' THEN 'service-down' WHEN 'signup' THEN 'service-up' ELSE 'heartbeat' END AS event
  FROM events)"""

FEEDBACK = """
feedback AS (
  SELECT event_id, ts, user_id, 'hint' || CAST(event_id % 12 AS VARCHAR) AS suggestion, value,
         CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'dismissed'
              WHEN 'signup' THEN 'asked' ELSE 'shown' END AS outcome,
         CASE WHEN event_type = 'error'
              THEN CASE event_id % 3 WHEN 0 THEN 'not-now' WHEN 1 THEN 'never' ELSE 'wrong-tool' END END AS lesson
  FROM events)"""

# Customers stand for outputs made from orders, orders for outputs made from parts.
LINEAGE = """
lineage AS (
  SELECT DISTINCT 'cust:' || CAST(o_custkey AS VARCHAR) AS output, 'order:' || CAST(o_orderkey AS VARCHAR) AS input
  FROM orders
  UNION ALL
  SELECT DISTINCT 'order:' || CAST(l_orderkey AS VARCHAR), 'part:' || CAST(l_partkey AS VARCHAR) FROM lineitem)"""


def _text(c) -> F.Column:
    return F.col(c).cast("string")


def _doc_path(folder) -> F.Column:
    return F.concat(folder, _text("doc_id"), F.lit(".txt"))


def corpus_prev(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter(F.col("doc_id") % 10 != 1)
    return docs.select(
        _doc_path(F.concat(F.lit("/lib/"), "source", F.lit("/"))).alias("path"),
        F.col("text").alias("content"),
        F.length("text").cast("long").alias("size"),
        (F.lit(1700000000) + F.col("doc_id")).cast("long").alias("mtime"),
    )


def corpus_cur(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter(F.col("doc_id") % 10 != 9)
    kind = F.col("doc_id") % 10
    folder = F.when(kind == 5, F.lit("/lib/moved/")).otherwise(F.concat(F.lit("/lib/"), "source", F.lit("/")))
    content = F.when(kind == 3, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    return docs.select(
        _doc_path(folder).alias("path"),
        content.alias("content"),
        F.length(content).cast("long").alias("size"),
        (F.lit(1700000000) + F.col("doc_id") + F.when(kind.isin(3, 7), 1).otherwise(0)).cast("long").alias("mtime"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    times = table(spark, sf, "events").select(F.col("event_id").alias("vec_id"), "ts")
    return (
        table(spark, sf, "embeddings")
        .join(times, "vec_id", "left")
        .select(
            F.col("vec_id").alias("item_id"),
            F.concat(F.lit("item-"), _text("vec_id")).alias("content_hash"),
            F.when(F.col("vec_id") % 10 == 9, "model-b").otherwise("model-a").alias("model"),
            F.col("embedding").alias("vec"),
            "label",
            F.when(F.col("vec_id") % 7 != 0, F.col("ts")).alias("capture_ts"),
        )
    )


def route_inputs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    toxic = table(spark, sf, "labels").select("doc_id", "toxic")
    third = F.col("doc_id") % 3
    return docs.join(toxic, "doc_id", "left").select(
        "doc_id",
        ((F.col("doc_id") % 100).cast("double") / 100).alias("local_confidence"),
        (((F.col("doc_id") * 7) % 100).cast("double") / 100).alias("complexity"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("sensitive"),
        (F.col("doc_id") % 13 != 0).alias("online"),
        F.when(third == 0, "airgapped").when(third == 1, "balanced").otherwise("cloud-boosted").alias("dial"),
    )


def journal_batch(spark: SparkSession, sf: str) -> DataFrame:
    buy = F.col("event_type") == "purchase"
    quarter = F.col("event_id") % 4
    return table(spark, sf, "events").select(
        F.col("event_id").alias("ord"),
        "ts",
        F.when(F.col("user_id") % 2 == 0, "user").otherwise("agent").alias("actor"),
        F.concat(F.lit("cap."), "event_type").alias("capability"),
        F.col("user_id").alias("subject"),
        F.when(buy, "irreversible").otherwise("undoable").alias("kind"),
        F.when(buy & (F.col("event_id") % 3 != 0), F.col("event_id") - 1).alias("consent_seq"),
        F.when(~buy, F.concat(F.lit('{"op":"restore","target":'), _text("event_id"), F.lit("}"))).alias("inverse"),
        F.when(quarter == 0, "local").when(quarter == 1, "remote-a").when(quarter == 2, "remote-b").alias("engine"),
    )


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("svc"), _text("user_id")).alias("service"),
        F.when(kind == "error", "service-down").when(kind == "signup", "service-up").otherwise("heartbeat").alias("event"),
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    third = F.col("event_id") % 3
    outcome = (
        F.when(kind == "purchase", "accepted").when(kind == "error", "dismissed").when(kind == "signup", "asked")
    )
    lesson = F.when(third == 0, "not-now").when(third == 1, "never").otherwise("wrong-tool")
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.concat(F.lit("hint"), (F.col("event_id") % 12).cast("string")).alias("suggestion"),
        "value",
        outcome.otherwise("shown").alias("outcome"),
        F.when(kind == "error", lesson).alias("lesson"),
    )


def lineage(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "orders").select(
        F.concat(F.lit("cust:"), _text("o_custkey")).alias("output"),
        F.concat(F.lit("order:"), _text("o_orderkey")).alias("input"),
    )
    used = table(spark, sf, "lineitem").select(
        F.concat(F.lit("order:"), _text("l_orderkey")).alias("output"),
        F.concat(F.lit("part:"), _text("l_partkey")).alias("input"),
    )
    return made.unionByName(used).distinct()


def doc_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a file: path, content, size."""
    return table(spark, sf, "documents").select(
        "doc_id",
        _doc_path(F.concat(F.lit("/lib/"), "source", F.lit("/"))).alias("path"),
        F.col("text").alias("content"),
        "source",
        "lang",
    )
