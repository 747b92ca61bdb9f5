"""Routing, redaction and egress queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.functions.text import tokens
from cairnfield.operators import policy as R
from cairnfield.plans import inputs
from cairnfield.plans.registry import query, table
from cairnfield.plans.text_queries import WORDS

DECIDED = f"""{inputs.ROUTE_INPUTS},
drivers AS (SELECT *, local_confidence < 0.6 AS unsure, complexity > 0.6 AS heavy,
    concat_ws('; ', CASE WHEN local_confidence < 0.6 THEN printf('local confidence %.2f < 0.6', local_confidence) END,
                    CASE WHEN complexity > 0.6 THEN printf('complexity %.2f > 0.6', complexity) END) AS why FROM route_inputs),
decided AS (SELECT doc_id, dial,
  CASE WHEN NOT online OR dial = 'airgapped' OR NOT (unsure OR heavy) THEN 'local' ELSE 'escalate' END AS engine,
  CASE WHEN NOT online OR dial = 'airgapped' THEN 0.99 WHEN NOT (unsure OR heavy) THEN 0.8
       WHEN dial = 'balanced' AND sensitive THEN 0.7 ELSE 0.85 END::DOUBLE AS confidence,
  CASE WHEN NOT online OR dial = 'airgapped' OR NOT (unsure OR heavy) THEN false ELSE sensitive END AS redact,
  CASE WHEN NOT online THEN 'no network: kept local, remote work waits'
       WHEN dial = 'airgapped' THEN 'airgapped by the privacy dial: kept local'
       WHEN NOT (unsure OR heavy) THEN 'light task and a confident local answer: kept local'
       WHEN dial = 'cloud-boosted' THEN 'sent out (' || why || ') under the cloud-boosted dial'
       WHEN sensitive THEN 'sent out redacted (' || why || '); sensitive parts wait for consent'
       ELSE 'sent out (' || why || ')' END AS reason,
  CASE WHEN NOT online OR dial = 'airgapped' OR NOT (unsure OR heavy) THEN 'none' WHEN unsure AND heavy THEN 'both'
       WHEN unsure THEN 'confidence' ELSE 'complexity' END AS driver FROM drivers)"""


@query("route_decisions", f"WITH {DECIDED} SELECT doc_id, engine, confidence, reason, redact FROM decided")
def route_decisions(spark, sf):
    return R.route(inputs.route_inputs(spark, sf)).select("doc_id", "engine", "confidence", "reason", "redact")


@query(
    "route_defaults",
    """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1.0 WHEN doc_id % 4 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS local_confidence,
       0.0::DOUBLE AS complexity, true AS online,
       CASE doc_id % 6 WHEN 0 THEN 'balanced' WHEN 5 THEN 'open' ELSE 'airgapped' END AS dial,
       CASE WHEN doc_id % 6 = 5 THEN 'unknown dial open' END AS error FROM documents""",
)
def route_defaults(spark, sf):
    """Inputs as text, some missing and some unreadable."""
    four, six = F.col("doc_id") % 4, F.col("doc_id") % 6
    raw = table(spark, sf, "documents").select(
        "doc_id",
        F.when(four == 1, "n/a").when(four > 1, "0.5").alias("local_confidence"),
        F.when(six == 5, "open").when(six > 0, "airgapped").alias("dial"),
    )
    ok, bad = R.with_route_defaults(raw)
    both = ok.unionByName(bad, allowMissingColumns=True)
    return both.select("doc_id", "local_confidence", "complexity", "online", "dial", "error")


@query(
    "route_report_cube",
    f"""
WITH {DECIDED}
SELECT engine, dial, driver, count(*) AS n, CAST(grouping_id(engine, dial, driver) AS INTEGER) AS level,
       round(count(*) / (SELECT count(*) FROM decided), 4) AS share FROM decided GROUP BY CUBE (engine, dial, driver)""",
)
def route_report_cube(spark, sf):
    decided = R.route(inputs.route_inputs(spark, sf)).withColumn("driver", R.driver_of(F.col("drivers")))
    return R.route_report(decided).withColumn("share", F.round("share", 4))


_KINDS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS span FROM documents"
    for kind, p in R.PATTERNS.items()
)

FLAGGED = f"""
flagged AS (SELECT DISTINCT name FROM (SELECT unnest({WORDS.format('text')}) AS name FROM benchmark) WHERE length(name) >= 14)"""


@query(
    "pii_spans",
    f"""
WITH {FLAGGED},
spans AS ({_KINDS}
  UNION ALL SELECT doc_id, 'entity', w FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents)
  JOIN flagged ON flagged.name = w)
SELECT doc_id, kind, count(*) AS n, min(span) AS first_span FROM spans GROUP BY 1, 2""",
)
def pii_spans(spark, sf):
    """Personal data per document; long words of the benchmark passages stand for flagged names."""
    names = table(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("name"))
    names = names.filter(F.length("name") >= 14)
    spans = R.detect_spans(table(spark, sf, "documents"), "doc_id", "text", entities=names)
    return spans.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("first_span"))


def _masked_sql() -> str:
    ctes, source = [], "(SELECT doc_id, text, text AS masked, CAST(0 AS BIGINT) AS chars FROM documents)"
    for i, (kind, p) in enumerate(R.PATTERNS.items()):
        ctes.append(
            f"m{i} AS (SELECT doc_id, text, regexp_replace(masked, '{p}', '[{kind}]', 'g') AS masked,"
            f" CAST(chars + list_sum(list_concat([0], [length(s) FOR s IN regexp_extract_all(masked, '{p}')])) AS BIGINT) AS chars FROM {source})"
        )
        source = f"m{i}"
    return ",\n".join(ctes), source


_MASKS, _LAST = _masked_sql()


@query(
    "pii_redact",
    f"""
WITH {_MASKS}
SELECT doc_id, md5(masked) AS digest, chars AS masked_chars,
       CASE WHEN chars = 0 THEN 'pass' WHEN chars / greatest(length(text), 1) > 0.02 THEN 'hold' ELSE 'mask' END AS action
FROM {_LAST}""",
)
def pii_redact(spark, sf):
    done = R.redact(table(spark, sf, "documents").select("doc_id", "text"), hold_ratio=0.02)
    return done.select("doc_id", F.md5("masked").alias("digest"), "masked_chars", "action")


@query("egress_excerpt", "SELECT doc_id, substr(text, 1, 800) AS excerpt FROM documents")
def egress_excerpt(spark, sf):
    return R.minimise(table(spark, sf, "documents")).select("doc_id", "excerpt")


@query(
    "dial_resolve",
    """
WITH items AS (SELECT d.doc_id, '/lib/' || source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS path, source, lang,
                      coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT path, CASE WHEN toxic = 1 THEN 'airgapped' WHEN source LIKE 'src1%' THEN 'cloud-boosted'
                  WHEN lang = 'fr' THEN 'balanced' WHEN true THEN 'cloud-boosted' END AS dial,
       CASE WHEN toxic = 1 THEN 'item' WHEN source LIKE 'src1%' THEN 'folder' WHEN lang = 'fr' THEN 'entity' ELSE 'folder' END AS decided_by
FROM items WHERE NOT (toxic = 0 AND source NOT LIKE 'src1%')
UNION ALL
SELECT path, 'airgapped', 'folder' FROM items WHERE toxic = 0 AND source NOT LIKE 'src1%' AND source LIKE 'src2%'
UNION ALL
SELECT path, CASE WHEN lang = 'fr' THEN 'airgapped' ELSE 'balanced' END, CASE WHEN lang = 'fr' THEN 'entity' ELSE 'default' END
FROM items WHERE toxic = 0 AND source NOT LIKE 'src1%' AND source NOT LIKE 'src2%'""",
)
def dial_resolve(spark, sf):
    """Toxic documents are kept in; folders of some sources and one language carry their own dial."""
    docs = inputs.doc_paths(spark, sf)
    items = docs.select("doc_id", "path", F.array("lang").alias("entities"))
    toxic = table(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    by_item = docs.join(toxic, "doc_id").select("path", F.lit(R.AIRGAPPED).alias("dial"))
    sources = docs.select("source").distinct()
    tens = F.col("source").startswith("src1")
    by_folder = sources.filter(tens | F.col("source").startswith("src2")).select(
        F.concat(F.lit("/lib/"), "source").alias("folder"), F.when(tens, R.BOOSTED).otherwise(R.AIRGAPPED).alias("dial")
    )
    by_entity = docs.select(F.col("lang").alias("entity")).distinct().filter(F.col("entity") == "fr")
    by_entity = by_entity.withColumn("dial", F.lit(R.AIRGAPPED))
    return R.resolve_dial(items, by_item, by_folder, by_entity).select("path", "dial", "decided_by")


@query(
    "egress_daily",
    f"""
WITH {inputs.JOURNAL_BATCH},
sent AS (SELECT j.ts, j.engine AS destination, strlen(substr(d.text, 1, 800)) AS bytes,
                len(regexp_extract_all(d.text, '{R.PATTERNS["email"]}')) AS redactions
  FROM journal_batch j JOIN documents d ON d.doc_id = j.ord % (SELECT count(*) FROM documents) WHERE engine <> 'local')
SELECT date_trunc('day', ts)::TIMESTAMP AS day, destination, count(*) AS calls, CAST(sum(bytes) AS BIGINT) AS bytes,
       CAST(sum(redactions) AS BIGINT) AS redactions FROM sent GROUP BY 1, 2""",
)
def egress_daily(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    total = docs.select(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))  # one row
    sent = inputs.journal_batch(spark, sf).filter(F.col("engine") != "local").withColumn("one", F.lit(1))
    sent = sent.join(F.broadcast(total), "one").withColumn("doc_id", F.col("ord") % F.col("n"))
    measured = R.minimise(docs).select(
        "doc_id",
        F.octet_length("excerpt").alias("bytes"),
        F.regexp_count("text", F.lit(R.PATTERNS["email"])).alias("redactions"),
    )
    joined = sent.join(measured, "doc_id").select("ts", F.col("engine").alias("destination"), "bytes", "redactions")
    return R.egress_daily(joined)
