"""Routing decisions, sensitive spans, redaction and egress reports."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.text import tokens
from cairnfield.operators.skew import LISTED_ROWS, listed, lookup_join

# Thresholds, dial positions, confidences and defaults of the routing rules.
CONFIDENCE_FLOOR = 0.6
COMPLEXITY_CEILING = 0.6
AIRGAPPED, BALANCED, BOOSTED = "airgapped", "balanced", "cloud-boosted"
DIALS = (AIRGAPPED, BALANCED, BOOSTED)
FORCED, LIGHT, ESCALATED, HELD = 0.99, 0.80, 0.85, 0.70
DEFAULTS = {"local_confidence": 1.0, "complexity": 0.0, "sensitive": False, "online": True, "dial": BALANCED}
EXCERPT_CHARS = 800

# Spans to hide, in masking order; the syntax stays in what Java and RE2 share.
PATTERNS = {
    "secret": r"(?:api[_-]?key|API[_-]?KEY|[Tt]oken|[Ss]ecret|[Pp]assword)[ \t]*[:=][ \t]*[^\s,;]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "card": r"[0-9](?:[ -]?[0-9]){12,15}",
    "phone": r"\+?[0-9]{1,3}[ -]\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}",
}
# Characters of which a text must hold one for the pattern of that kind to match; a quick test before the costly one.
HINTS = {"email": ("@",), "secret": (":", "=")}


def route_column(conf_floor: float = CONFIDENCE_FLOOR, complexity_ceil: float = COMPLEXITY_CEILING) -> Column:
    """Decision struct from ``local_confidence, complexity, sensitive, online, dial``; the first rule that holds wins."""
    unsure = F.col("local_confidence") < conf_floor
    heavy = F.col("complexity") > complexity_ceil
    drivers = F.concat_ws(
        "; ",
        F.when(unsure, F.format_string(f"local confidence %.2f < {conf_floor}", "local_confidence")),
        F.when(heavy, F.format_string(f"complexity %.2f > {complexity_ceil}", "complexity")),
    )

    def decide(engine: str, confidence, reason: Column, redact: Column) -> Column:
        return F.struct(
            F.lit(engine).alias("engine"),
            F.lit(confidence).alias("confidence"),
            reason.alias("reason"),
            redact.alias("redact"),
            F.when(F.lit(engine) == "escalate", drivers).otherwise(F.lit("")).alias("drivers"),
        )

    def stay(confidence: float, why: str) -> Column:
        return decide("local", confidence, F.lit(why), F.lit(False))

    def leave(confidence: float, text: str, redact: Column) -> Column:
        return decide("escalate", confidence, F.format_string(text, drivers), redact)

    boosted = F.col("dial") == BOOSTED
    return (
        F.when(~F.col("online"), stay(FORCED, "no network: kept local, remote work waits"))
        .when(F.col("dial") == AIRGAPPED, stay(FORCED, "airgapped by the privacy dial: kept local"))
        .when(~unsure & ~heavy, stay(LIGHT, "light task and a confident local answer: kept local"))
        .when(boosted, leave(ESCALATED, "sent out (%s) under the cloud-boosted dial", F.col("sensitive")))
        .when(F.col("sensitive"), leave(HELD, "sent out redacted (%s); sensitive parts wait for consent", F.lit(True)))
        .otherwise(leave(ESCALATED, "sent out (%s)", F.lit(False)))
    )


def route(df: DataFrame, conf_floor: float = CONFIDENCE_FLOOR, complexity_ceil: float = COMPLEXITY_CEILING) -> DataFrame:
    """Add ``engine, confidence, reason, redact`` and the ``drivers`` of an escalation."""
    decided = df.withColumn("_d", route_column(conf_floor, complexity_ceil))
    parts = ["engine", "confidence", "reason", "redact", "drivers"]
    return decided.select(*[c for c in df.columns if c not in parts], *[F.col(f"_d.{p}").alias(p) for p in parts])


def with_route_defaults(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing or unreadable inputs get their defaults; rows with an unknown dial go to the second result."""
    kinds = {"local_confidence": "double", "complexity": "double", "sensitive": "boolean", "online": "boolean", "dial": "string"}
    filled = df
    for name, kind in kinds.items():
        given = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        filled = filled.withColumn(name, F.coalesce(given, F.lit(DEFAULTS[name])))
    known = F.col("dial").isin(*DIALS)
    rejected = filled.filter(~known).withColumn("error", F.concat(F.lit("unknown dial "), "dial"))
    return filled.filter(known), rejected


def route_report(decisions: DataFrame) -> DataFrame:
    """Counts by engine, dial and driver of the decision, over every combination, with the share of all rows."""
    cubed = decisions.cube("engine", "dial", "driver").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")
    )
    total = decisions.select(F.count(F.lit(1)).alias("_total"), F.lit(1).alias("_one"))  # one row
    joined = cubed.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return joined.withColumn("share", F.col("n") / F.col("_total")).drop("_total", "_one")


def driver_of(drivers: Column) -> Column:
    """Which thresholds a decision crossed: none, confidence, complexity or both."""
    unsure, heavy = F.contains(drivers, F.lit("confidence")), F.contains(drivers, F.lit("complexity"))
    return F.when(unsure & heavy, "both").when(unsure, "confidence").when(heavy, "complexity").otherwise("none")


def detect_spans(
    df: DataFrame, key: str, text: str, patterns: Mapping[str, str] = PATTERNS, entities: DataFrame | None = None,
    listed_rows: int = LISTED_ROWS,
) -> DataFrame:
    """One row per sensitive span: ``key, kind, span``; ``entities`` (``name``) adds flagged single words.

    Up to ``listed_rows`` names are looked for in the words of a text in the same pass; more are joined.
    """
    whole = F.col(text)
    found = [_tagged(_all_of(whole, kind, p), kind) for kind, p in patterns.items()]
    if entities is None:
        return df.select(key, F.inline(F.concat(*found)))
    names = entities.select("name").filter(F.col("name").isNotNull()).distinct()
    inside = listed(names, "name", listed_rows)
    if inside is not None:
        flagged = F.filter(tokens(whole), lambda w: w.isin(inside)) if inside else F.array().cast("array<string>")
        return df.filter(whole.isNotNull()).select(key, F.inline(F.concat(*found, _tagged(flagged, "entity"))))
    spans = df.select(key, F.inline(F.concat(*found)))
    words = df.select(key, F.posexplode(tokens(whole)).alias("_at", "name"))
    met = lookup_join(words, names, ["name"], "inner", spread=[key, "_at"])
    return spans.unionByName(met.select(key, F.lit("entity").alias("kind"), F.col("name").alias("span")))


def _all_of(text: Column, kind: str, pattern: str) -> Column:
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind not in HINTS or PATTERNS.get(kind) != pattern:
        return every
    hinted = functools.reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in HINTS[kind]])
    return F.when(hinted, every).otherwise(F.array().cast("array<string>"))


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("span")))


def redact(df: DataFrame, text: str = "text", patterns: Mapping[str, str] = PATTERNS, hold_ratio: float = 0.5) -> DataFrame:
    """Add ``masked`` text, ``masked_chars`` and ``action``: hold when masks cover more than ``hold_ratio`` of it."""
    staged = df.withColumns({"masked": F.col(text), "masked_chars": F.lit(0).cast("long")})
    for kind, pattern in patterns.items():
        mask = f"[{kind}]"
        hidden = F.regexp_replace("masked", pattern, mask)
        count = F.regexp_count("masked", F.lit(pattern))
        staged = staged.withColumns({"_next": hidden, "_count": count})
        lost = F.length("masked") - F.length("_next") + F.col("_count") * len(mask)
        staged = staged.withColumn("masked_chars", F.col("masked_chars") + lost).withColumn("masked", F.col("_next"))
    share = F.col("masked_chars") / F.greatest(F.length(text), F.lit(1))
    action = F.when(F.col("masked_chars") == 0, "pass").when(share > hold_ratio, "hold").otherwise("mask")
    return staged.drop("_next", "_count").withColumn("action", action)


def minimise(df: DataFrame, text: str = "text", chars: int = EXCERPT_CHARS) -> DataFrame:
    """Add ``excerpt``: the beginning of the text that may leave instead of the whole."""
    return df.withColumn("excerpt", F.substring(text, 1, chars))


def resolve_dial(
    items: DataFrame,
    by_item: DataFrame,
    by_folder: DataFrame,
    by_entity: DataFrame,
    default: str = BALANCED,
) -> DataFrame:
    """Add ``dial`` and ``decided_by`` to ``items`` (``path, entities``): item, then deepest folder, then entity.

    Overrides have ``path``/``folder``/``entity`` and ``dial``. Folders are matched by an equi-join on the ancestors
    of each path; equal claims go to the alphabetically first dial.
    """
    steps = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.struct(
        F.when(n == 1, "/").otherwise(F.array_join(F.slice(steps, 1, n), "/")).alias("folder"), n.alias("depth")
    ))
    climbs = items.select("path", F.inline_outer(ancestors)).filter(F.col("folder").isNotNull())
    members = items.select("path", F.explode_outer("entities").alias("entity")).filter(F.col("entity").isNotNull())

    def claims(df: DataFrame, level: int, depth: Column, name: str) -> DataFrame:
        return df.select("path", F.struct(
            F.lit(-level).alias("level"), (-depth).cast("int").alias("depth"), F.col("dial"), F.lit(name).alias("by")
        ).alias("claim"))

    own = claims(by_item, 3, F.lit(0), "item")
    folder = claims(lookup_join(climbs, by_folder, ["folder"], "inner", spread=["path"]), 2, F.col("depth"), "folder")
    entity = claims(lookup_join(members, by_entity, ["entity"], "inner", spread=["path"]), 1, F.lit(0), "entity")
    best = own.unionByName(folder).unionByName(entity).groupBy("path").agg(F.min("claim").alias("claim"))
    return items.join(best, "path", "left").select(
        *items.columns,
        F.coalesce("claim.dial", F.lit(default)).alias("dial"),
        F.coalesce("claim.by", F.lit("default")).alias("decided_by"),
    )


def egress_daily(df: DataFrame) -> DataFrame:
    """Calls, bytes and redactions per day and destination of ``ts, destination, bytes, redactions``; also on a stream."""
    return df.groupBy(F.window("ts", "1 day").alias("_w"), "destination").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("bytes").alias("bytes"), F.sum("redactions").alias("redactions")
    ).select(F.col("_w.start").alias("day"), "destination", "calls", "bytes", "redactions")
