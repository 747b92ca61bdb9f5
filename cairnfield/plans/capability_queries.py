"""Capability queries: manifests met by documents, conversations and habits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnfield.operators import capabilities as M
from cairnfield.operators import facets as O
from cairnfield.operators.habits import next_actions
from cairnfield.plans import inputs
from cairnfield.plans.facet_queries import RESOLVED_OF
from cairnfield.plans.registry import query, table
from cairnfield.plans.text_queries import WORDS
from cairnfield.session import shared_folder
from cairnfield.sources.manifests import MANIFEST_SCHEMA, read_manifests

# (id, facet, minimum, count, triggers, permissions, reversibility); the capability of each event type.
MANIFESTS = [
    ("cap.view", "*", 0.5, ">=1", ["the", "of the"], ["read:selected-items"], "undoable"),
    ("cap.click", "text", 0.7, ">=40", ["and", "in the"], ["read:selected-items", "write:items"], "undoable"),
    ("cap.purchase", "notes", 0.6, ">=50", ["la", "de la"], ["read:selected-items", "net:send"], "gated-irreversible"),
    ("cap.signup", "notes", 0.6, "==49", ["der", "und"], ["read:selected-items"], "undoable"),
    ("cap.error", "image", 0.7, ">=1", ["paint"], ["read:selected-items"], "undoable"),
]

RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', '{f}', {m}::DOUBLE, '{c[:2]}', {int(c[2:])}, {t!r}, {p!r})" for i, f, m, c, t, p, _ in MANIFESTS
) + ") AS t(capability, facet, floor, op, wanted, triggers, scopes))"


def manifests(spark):
    rows = [
        (i, "1.0.0", [(f, m, c)], t, ({"items": "item[]"}, {}, [], None), ("panel", [], "main"), p, [], r)
        for i, f, m, c, t, p, r in MANIFESTS
    ]
    return spark.createDataFrame(rows, MANIFEST_SCHEMA)


FACETS = f"""
files AS (SELECT CAST(doc_id AS VARCHAR) || '/' || source AS path, text AS content, 'txt' AS ext FROM documents),{RESOLVED_OF},
facets AS (SELECT path AS item, split_part(path, '/', 2) AS selection, kind, confidence FROM resolved),
readings AS (SELECT * FROM facets UNION ALL SELECT item, selection, '*', max(confidence) FROM facets GROUP BY 1, 2)"""

ELIGIBLE = f"""{FACETS},{RULES},
counted AS (SELECT selection, capability, op, wanted, count(*) AS n_items FROM readings JOIN rules ON facet = kind AND confidence >= floor
  GROUP BY ALL),
applicable AS (SELECT selection, capability, n_items FROM counted WHERE CASE op WHEN '==' THEN n_items = wanted ELSE n_items >= wanted END)"""


def _eligible(spark, sf):
    docs = inputs.doc_paths(spark, sf)
    rows = O.facet_rows(O.resolve_facets(docs), "doc_id", "source")
    shown = rows.select(F.col("source").alias("selection"), F.col("doc_id").alias("item"), "kind", "confidence")
    return M.eligible(shown, manifests(spark))


@query("capability_eligibility", f"WITH {ELIGIBLE} SELECT selection, capability, n_items FROM applicable")
def capability_eligibility(spark, sf):
    """Each source is one selection of documents."""
    return _eligible(spark, sf)


@query(
    "capability_rank",
    f"""
WITH {ELIGIBLE},
steps AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
habits AS (SELECT 'cap.' || b AS capability, count(*) / sum(count(*)) OVER () AS confidence FROM steps
  WHERE a = 'view' AND b IS NOT NULL GROUP BY b)
SELECT selection, capability, n_items, round(coalesce(confidence, 0), 4) AS confidence,
       row_number() OVER (PARTITION BY selection ORDER BY coalesce(confidence, 0) DESC, capability) AS rank
FROM applicable LEFT JOIN habits USING (capability)""",
)
def capability_rank(spark, sf):
    """Ordered by what usually follows a view."""
    habits = next_actions(table(spark, sf, "events")).filter(F.col("a") == "view")
    habits = habits.select(F.concat(F.lit("cap."), "b").alias("capability"), F.col("probability").alias("confidence"))
    ranked = M.rank_capabilities(_eligible(spark, sf), habits)
    return ranked.select("selection", "capability", "n_items", F.round("confidence", 4).alias("confidence"), "rank")


@query(
    "intent_trigger_match",
    f"""
WITH {RULES},
said AS (SELECT conv_id * 1000 + turn AS utterance, ' ' || array_to_string({WORDS.format('text')}, ' ') || ' ' AS words FROM conversations),
phrases AS (SELECT capability, unnest(triggers) AS phrase FROM rules),
hits AS (SELECT utterance, capability, max(length(phrase)) AS longest, count(*) AS n_triggers
  FROM said JOIN phrases ON contains(words, ' ' || phrase || ' ') GROUP BY 1, 2)
SELECT utterance, capability, CAST(longest AS INTEGER) AS longest, n_triggers,
       row_number() OVER (PARTITION BY utterance ORDER BY longest DESC, n_triggers DESC, capability) AS rank FROM hits""",
)
def intent_trigger_match(spark, sf):
    said = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("utterance"), "text")
    return M.match_triggers(said, manifests(spark))


@query(
    "scope_violations",
    f"""
WITH {RULES},
grants AS (SELECT 'cap.' || event_type AS capability, max(ts) FILTER (user_id % 2 = 0) AS last_even, max(ts) AS last FROM events
  WHERE event_type <> 'error' GROUP BY 1),
asked AS (SELECT event_id AS request, 'cap.' || event_type AS capability,
    CASE WHEN event_id % 7 = 0 THEN ['read:selected-items', 'net:send'] ELSE ['read:selected-items'] END AS asked FROM events),
judged AS (SELECT request, a.capability,
    array_to_string(list_sort(list_filter(asked, lambda x: NOT list_contains(scopes, x))), ',') AS undeclared,
    g.capability IS NULL OR (last_even IS DISTINCT FROM last AND len(list_filter(scopes, lambda x: x <> 'read:selected-items')) > 0) AS needs_consent
  FROM asked a JOIN rules r ON r.capability = a.capability LEFT JOIN grants g ON g.capability = a.capability)
SELECT request, capability, coalesce(undeclared, '') AS undeclared, needs_consent FROM judged WHERE coalesce(undeclared, '') <> '' OR needs_consent""",
)
def scope_violations(spark, sf):
    """Even users granted everything declared, odd users reading only; the latest grant counts."""
    events = table(spark, sf, "events")
    reading = F.array(F.lit("read:selected-items"))
    requests = events.select(
        F.col("event_id").alias("request"),
        F.concat(F.lit("cap."), "event_type").alias("capability"),
        F.when(F.col("event_id") % 7 == 0, F.array(F.lit("read:selected-items"), F.lit("net:send"))).otherwise(reading).alias("scopes"),
    )
    known = manifests(spark)
    declared = known.select(F.col("id").alias("capability"), "permissions")
    grants = events.filter(F.col("event_type") != "error").withColumn("capability", F.concat(F.lit("cap."), "event_type"))
    grants = grants.join(declared, "capability").select(
        "capability",
        F.when(F.col("user_id") % 2 == 0, F.col("permissions")).otherwise(reading).alias("scopes"),
        F.col("ts").alias("granted_at"),
    )
    return M.scope_violations(requests, known, grants)


@query(
    "manifest_violations",
    """
WITH m AS (SELECT p_partkey AS k, 'cap.' || (p_partkey - CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END) AS id FROM part),
twice AS (SELECT id FROM m GROUP BY 1 HAVING count(*) > 1)
SELECT id, 'missing version' AS rule FROM m WHERE k % 7 = 0
UNION ALL SELECT id, 'missing contract' FROM m WHERE k % 5 = 0
UNION ALL SELECT id, 'no facet predicate' FROM m WHERE k % 3 = 0
UNION ALL SELECT id, 'facet minimum outside 0..1' FROM m WHERE k % 3 <> 0 AND k % 23 = 0
UNION ALL SELECT id, 'unreadable count' FROM m WHERE k % 3 <> 0 AND k % 29 = 0
UNION ALL SELECT id, 'unknown reversibility' FROM m WHERE k % 13 = 0
UNION ALL SELECT id, 'network scope without gate' FROM m WHERE k % 17 = 0
UNION ALL SELECT id, 'id used twice' FROM twice""",
)
def manifest_violations(spark, sf):
    """A manifest per part, as JSON documents that are read back, with faults by rule."""
    n = F.col("p_partkey")
    every = lambda d: n % d == 0
    predicate = F.struct(
        F.lit("text").alias("facet"), F.when(every(23), 1.5).otherwise(0.5).alias("min"), F.when(every(29), "some").otherwise(">=1").alias("count")
    )
    manifests = table(spark, sf, "part").select(
        F.concat(F.lit("cap."), (n - F.when(every(19), 1).otherwise(0)).cast("string")).alias("id"),
        F.when(every(7), " ").otherwise("1").alias("version"),
        F.when(~every(3), F.array(predicate)).alias("appliesTo"),
        F.when(~every(5), F.struct(F.lit("none").alias("reasoning"))).alias("contract"),
        F.when(every(17), F.array(F.lit("net:send"))).alias("permissions"),
        F.when(every(13), "maybe").otherwise("undoable").alias("reversibility"),
    )
    folder = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    manifests.write.json(folder)
    return M.validate_manifests(read_manifests(spark, folder, one_per_line=True))
