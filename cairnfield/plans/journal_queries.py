"""Journal queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.operators import journal as L
from cairnfield.plans import inputs
from cairnfield.plans.registry import query, table

WITH = f"WITH {inputs.JOURNAL}"


def journal(spark, sf):
    accepted, _ = L.gate(inputs.journal_batch(spark, sf))
    return L.assign_seq(accepted, 0, "ord")


@query(
    "journal_gate",
    f"""
WITH {inputs.JOURNAL_BATCH}
SELECT ord, kind, CASE WHEN kind = 'irreversible' AND consent_seq IS NULL
                       THEN 'no consent for irreversible ' || capability END AS reason FROM journal_batch""",
)
def journal_gate(spark, sf):
    accepted, rejected = L.gate(inputs.journal_batch(spark, sf))
    return accepted.unionByName(rejected, allowMissingColumns=True).select("ord", "kind", "reason")


@query("journal_sequence", f"{WITH} SELECT ord, seq FROM journal")
def journal_sequence(spark, sf):
    return journal(spark, sf).select("ord", "seq")


@query("journal_read", f"{WITH} SELECT seq, ts, actor, capability, subject, kind, engine FROM journal WHERE seq >= 0")
def journal_read(spark, sf):
    return L.read_range(journal(spark, sf), 0).select("seq", "ts", "actor", "capability", "subject", "kind", "engine")


@query("journal_tail", f"{WITH} SELECT max(seq) + 1 AS next_seq FROM journal")
def journal_tail(spark, sf):
    return L.next_seq(journal(spark, sf))


@query(
    "journal_append",
    f"""
{WITH}, later AS (SELECT (SELECT max(seq) + 1 FROM journal) + row_number() OVER (ORDER BY ord) - 1 AS seq, ord FROM journal)
SELECT ord, seq FROM later""",
)
def journal_append(spark, sf):
    """The same batch arriving a second time continues the numbering."""
    ready, _ = L.journal_append(journal(spark, sf), inputs.journal_batch(spark, sf), "ord")
    return ready.select("ord", "seq")


@query(
    "journal_inverse",
    f"""
{WITH} SELECT seq, inverse, json_extract_string(inverse, '$.op') AS op FROM journal
WHERE seq IN (SELECT doc_id FROM documents)""",
)
def journal_inverse(spark, sf):
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"))
    return L.inverse_of(journal(spark, sf), asked)


@query(
    "undo_plan",
    f"""
{WITH}, wall AS (SELECT subject, max(seq) AS w FROM journal WHERE kind = 'irreversible' GROUP BY 1)
SELECT seq, subject, capability, inverse FROM journal LEFT JOIN wall USING (subject)
WHERE kind = 'undoable' AND seq > coalesce(w, -1)""",
)
def undo_plan(spark, sf):
    return L.undo_plan(journal(spark, sf), -1, per=["subject"])


@query(
    "journal_audit_rollup",
    f"""
{WITH} SELECT CAST(ts AS DATE) AS day, actor, coalesce(engine, 'none') AS engine, count(*) AS n,
       count(*) FILTER (kind = 'irreversible') AS irreversible,
       CAST(grouping_id(CAST(ts AS DATE), actor, coalesce(engine, 'none')) AS INTEGER) AS level
FROM journal GROUP BY ROLLUP (CAST(ts AS DATE), actor, coalesce(engine, 'none'))""",
)
def journal_audit_rollup(spark, sf):
    return L.audit_rollup(journal(spark, sf))


@query(
    "journal_lineage",
    """
SELECT DISTINCT o.output, 'part:' || l_partkey AS input, l_orderkey AS seq
FROM lineitem JOIN (SELECT o_orderkey, unnest(['order:' || o_orderkey, 'bill:' || o_orderkey]) AS output FROM orders) o ON o.o_orderkey = l_orderkey""",
)
def journal_lineage(spark, sf):
    """Orders as journal events that turn parts into an order and a bill."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    taken = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(text("part:", "l_partkey")).alias("inputs"))
    events = orders.join(taken, "l_orderkey").select(
        F.col("l_orderkey").alias("seq"), "inputs", F.array(text("order:", "l_orderkey"), text("bill:", "l_orderkey")).alias("outputs")
    )
    return L.made_from(events)


CLOSURE = f"""
WITH RECURSIVE {inputs.LINEAGE},
walk(output, source, depth) AS (
  SELECT output, input, 1 FROM lineage
  UNION
  SELECT w.output, l.input, w.depth + 1 FROM walk w JOIN lineage l ON l.output = w.source)
SELECT output, source, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1, 2"""


@query("provenance_closure_all", CLOSURE)
@query("provenance_closure", CLOSURE)
def provenance_closure(spark, sf):
    """Everything that is behind every output of the lineage: customers and orders."""
    return L.provenance(inputs.lineage(spark, sf))


@query(
    "journal_compact",
    f"""
{WITH}, marked AS (SELECT *, ts < TIMESTAMP '2024-01-15' AND NOT (kind = 'irreversible') AS folds FROM journal)
SELECT 'event' AS form, CAST(ts AS DATE) AS day, actor, capability, CAST(1 AS BIGINT) AS n, seq AS first_seq, seq AS last_seq
FROM marked WHERE NOT folds
UNION ALL
SELECT 'summary', CAST(ts AS DATE), actor, capability, count(*), min(seq), max(seq) FROM marked WHERE folds GROUP BY 2, 3, 4""",
)
def journal_compact(spark, sf):
    return L.compact(journal(spark, sf), "2024-01-15 00:00:00")


@query(
    "evidence_violations",
    f"""
{WITH}, memory AS (SELECT event_id AS memory_id, unnest([event_id, event_id * 2]) AS seq FROM events WHERE event_type <> 'view')
SELECT memory_id, seq AS missing_seq FROM memory WHERE seq NOT IN (SELECT seq FROM journal)
UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'view'""",
)
def evidence_violations(spark, sf):
    """Every event taught something; views cite nothing and late memories cite events never written."""
    cited = F.when(F.col("event_type") != "view", F.array("event_id", F.col("event_id") * 2))
    memory = table(spark, sf, "events").select(F.col("event_id").alias("memory_id"), cited.alias("evidence"))
    return L.evidence_violations(memory, journal(spark, sf))
