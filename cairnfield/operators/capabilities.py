"""Capability manifests matched to content, words and habits.

``manifests`` has the columns of :mod:`cairnfield.sources.manifests`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.text import tokens
from cairnfield.operators.skew import lookup_join

WILDCARD = "*"
COUNT_RULE = r"^(==|>=)([0-9]+)$"
REVERSIBILITIES = ("undoable", "gated-irreversible")
NET_SCOPE = "net:"


def validate_manifests(manifests: DataFrame) -> DataFrame:
    """Rule violations as ``id, rule``; a sound manifest gives no row."""
    rules = {
        "missing id": F.coalesce(F.trim("id"), F.lit("")) == "",
        "missing version": F.coalesce(F.trim("version"), F.lit("")) == "",
        "missing contract": F.col("contract").isNull(),
        "no facet predicate": F.coalesce(F.size("appliesTo"), F.lit(0)) < 1,
        "facet minimum outside 0..1": F.exists("appliesTo", lambda p: p["min"].isNull() | ~p["min"].between(0.0, 1.0)),
        "unreadable count": F.exists("appliesTo", lambda p: ~F.coalesce(p["count"].rlike(COUNT_RULE), F.lit(False))),
        "unknown reversibility": ~F.coalesce(F.col("reversibility").isin(*REVERSIBILITIES), F.lit(False)),
        "network scope without gate": F.exists("permissions", lambda s: s.startswith(NET_SCOPE))
        & (F.col("reversibility") != "gated-irreversible"),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    found = manifests.select("id", F.explode(broken).alias("rule"))
    twice = manifests.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return found.unionByName(twice.select("id", F.lit("id used twice").alias("rule")))


def _holds(count: Column, rule: Column) -> Column:
    wanted = F.regexp_extract(rule, COUNT_RULE, 2).try_cast("long")
    return F.when(rule.startswith("=="), count == wanted).otherwise(count >= wanted)


def eligible(facets: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifests that apply to each selection: ``selection, capability, n_items``.

    ``facets`` has ``selection, item, kind, confidence``, one row per item and kind. A predicate counts the items that
    show its facet (``*`` for any) with at least its confidence; a manifest applies when one of its predicates holds.
    """
    # Every reading also counts for the wildcard, so the facets are read once.
    readings = facets.select("selection", "item", "confidence", F.explode(F.array("kind", F.lit(WILDCARD))).alias("kind"))
    wanted = manifests.select(F.col("id").alias("capability"), F.posexplode("appliesTo").alias("_no", "_p"))
    wanted = wanted.select("capability", "_no", F.col("_p.facet").alias("kind"), F.col("_p.min").alias("_min"), F.col("_p.count").alias("_rule"))
    matched = lookup_join(readings, wanted, ["kind"]).filter(F.col("confidence") >= F.col("_min"))
    matched = matched.select("selection", "item", "capability", "_no", "_rule").distinct()
    counted = matched.groupBy("selection", "capability", "_no", "_rule").agg(F.count(F.lit(1)).alias("n_items"))
    holding = counted.filter(_holds(F.col("n_items"), F.col("_rule")))
    return holding.groupBy("selection", "capability").agg(F.max("n_items").alias("n_items"))


def match_triggers(utterances: DataFrame, manifests: DataFrame, key: str = "utterance", text: str = "text") -> DataFrame:
    """Capabilities whose trigger phrases occur in an utterance, best first: ``rank`` by longest, then most triggers.

    Phrases are matched as whole words by an equi-join on the word runs of each utterance.
    """
    triggers = manifests.select(F.col("id").alias("capability"), F.explode("intentTriggers").alias("trigger"))
    triggers = triggers.select("capability", tokens(F.col("trigger")).alias("_w")).select(
        "capability", F.array_join("_w", " ").alias("phrase"), F.size("_w").alias("_len")
    )
    lengths = sorted(r[0] for r in triggers.select("_len").distinct().collect())  # a few small numbers
    words = utterances.select(key, tokens(F.col(text)).alias("_t"))
    runs = F.concat(*[
        F.when(F.size("_t") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("_t") - n + 1, F.lit(1))), _run_of(n)))
        .otherwise(F.array().cast("array<string>"))
        for n in lengths
    ])
    phrases = words.select(key, F.explode_outer(F.array_distinct(runs)).alias("phrase")).filter(F.col("phrase").isNotNull())
    hits = lookup_join(phrases, triggers, ["phrase"]).groupBy(key, "capability").agg(
        F.max(F.length("phrase")).alias("longest"), F.count(F.lit(1)).alias("n_triggers")
    )
    # An utterance has at most as many rows as there are manifests.
    order = Window.partitionBy(key).orderBy(F.desc("longest"), F.desc("n_triggers"), "capability")
    return hits.withColumn("rank", F.row_number().over(order).cast("long"))


def _run_of(n: int):
    return lambda i: F.array_join(F.slice(F.col("_t"), i, n), " ")


def scope_violations(requests: DataFrame, manifests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests asking for more than declared, or whose capability lacks a grant of its present scopes.

    ``requests`` has ``request, capability, scopes``; ``grants`` has ``capability, scopes, granted_at`` and the latest
    one counts. Result: ``request, capability, undeclared, needs_consent``.
    """
    latest = grants.groupBy("capability").agg(F.max_by("scopes", F.struct("granted_at", F.array_join("scopes", ","))).alias("_granted"))
    declared = manifests.select(F.col("id").alias("capability"), F.col("permissions").alias("_declared"))
    # One row per manifest, joined before the requests come in.
    rules = declared.join(latest, "capability", "left")
    none = F.array().cast("array<string>")
    judged = requests.join(rules, "capability", "left").select(
        "request",
        "capability",
        F.array_join(F.array_sort(F.array_except("scopes", F.coalesce("_declared", none))), ",").alias("undeclared"),
        (
            F.col("_granted").isNull()
            | (F.size(F.array_except(F.coalesce("_declared", none), F.coalesce("_granted", none))) > 0)
        ).alias("needs_consent"),
    )
    return judged.filter((F.col("undeclared") != "") | F.col("needs_consent"))


def rank_capabilities(applicable: DataFrame, habits: DataFrame) -> DataFrame:
    """Eligible capabilities of each selection ordered by habit confidence (``capability, confidence``)."""
    scored = applicable.join(habits, "capability", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    # A selection has at most as many rows as there are manifests.
    order = Window.partitionBy("selection").orderBy(F.desc("confidence"), "capability")
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))
