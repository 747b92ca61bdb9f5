"""Facet resolution: several confidence-scored readings of one piece of content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import facets as P
from cairnfield.functions.facets import facet
from cairnfield.functions.text import extension


def extension_facets(df: DataFrame, name: str = "path") -> DataFrame:
    """Add ``ext``, ``by_extension`` (array of facets) and ``language`` from the file name."""
    table = P.extension_table(df.sparkSession)
    # A fixed table of about eighty rows.
    return df.withColumn("ext", extension(F.col(name))).join(F.broadcast(table), "ext", "left")


def _merged(candidates: Column) -> Column:
    """One facet per kind: highest confidence, first known detail; most confident first, then by kind."""
    kinds = F.array_distinct(F.transform(candidates, lambda c: c["kind"]))

    def of_kind(kind: Column) -> Column:
        mine = F.filter(candidates, lambda c: c["kind"] == kind)
        details = F.filter(F.transform(mine, lambda c: c["detail"]), lambda d: d.isNotNull())
        return F.struct(
            (-F.array_max(F.transform(mine, lambda c: c["confidence"]))).alias("order"),
            kind.alias("kind"),
            F.get(details, F.lit(0)).alias("detail"),
        )

    ordered = F.array_sort(F.transform(kinds, of_kind))
    return F.transform(ordered, lambda s: facet(s["kind"], -s["order"], s["detail"]))


def resolve_facets(df: DataFrame, name: str = "path", content: str = "content", head_bytes: int | None = None) -> DataFrame:
    """Add ``facets``. Whole content is read; ``head_bytes`` restricts the text signals to a beginning instead."""
    seen = F.col(content)
    if head_bytes is not None:
        seen = F.substring(seen.cast("binary"), 1, head_bytes)
    staged = extension_facets(df, name).withColumns({"_magic": P.sniff(F.col(content)), "_text": P.text_of(seen)})
    container = F.coalesce(F.col("_magic.kind").isin(P.CONTAINER_KINDS), F.lit(False))
    staged = staged.withColumn("_is_text", ~container & P.is_text(seen))
    t, ext = F.col("_text"), F.col("ext")
    code = (
        F.when(F.col("language").isNotNull(), facet("code", 0.9, F.col("language")))
        .when(P.shebang_lang(t).isNotNull(), facet("code", 0.85, P.shebang_lang(t)))
        .when(P.looks_like_code(t), facet("code", 0.65))
    )
    marked = ext.isin("md", "markdown") | P.looks_like_markdown(t)
    markdown = F.when(marked, facet("markdown", F.when(ext == "md", 0.9).otherwise(0.6)))
    data = (
        F.when(ext.isin("json", "ndjson", "jsonl") | P.looks_like_json(t), facet("data", 0.8, "json"))
        .when(ext.isin("csv", "tsv") | P.looks_like_csv(t), facet("data", 0.7, "csv"))
        .when(ext.isin("yaml", "yml", "toml"), facet("data", 0.8, ext))
    )
    todo = F.when(P.has_checkboxes(t), facet("todo", 0.8))
    read = {"_code": code, "_markdown": markdown, "_data": data, "_todo": todo, "_prose": P.looks_like_prose(t)}
    staged = staged.withColumns({n: F.when(F.col("_is_text"), c) for n, c in read.items()})
    plain = F.when(F.col("_is_text"), facet("text", 0.6))
    loose = F.col("_code").isNull() & F.col("_data").isNull() & F.col("_prose")
    notes = F.when(loose, facet("notes", 0.6))
    by_text = F.array("_code", "_markdown", "_data", "_todo", plain, notes)
    nothing = F.array().cast(f"array<{P.FACET}>")
    everything = F.concat(F.array("_magic"), F.coalesce("by_extension", nothing), by_text)
    staged = staged.withColumn("_all", F.filter(everything, lambda c: c.isNotNull()))
    known = F.when(F.size("_all") > 0, F.col("_all")).otherwise(F.array(facet("binary", 0.5)))
    resolved = staged.withColumn("_all", known).withColumn("facets", _merged(F.col("_all")))
    return resolved.drop("_magic", "_text", "_is_text", *read, "_all", "by_extension", "language", "ext")


def resolve_with(df: DataFrame, refiner: Callable[[DataFrame], DataFrame], **names) -> DataFrame:
    """Resolve, let ``refiner`` add an ``extra`` array of facets, and order all of them by confidence."""
    refined = refiner(resolve_facets(df, **names))
    joined = F.concat("facets", F.coalesce("extra", F.array().cast(f"array<{P.FACET}>")))
    placed = F.transform(joined, lambda f, i: F.struct((-f["confidence"]).alias("o"), i.alias("i"), f.alias("f")))
    return refined.withColumn("facets", F.transform(F.array_sort(placed), lambda s: s["f"])).drop("extra")


def facet_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key and facet.

    Every content has at least one facet; the outer form keeps the planner from testing that by resolving twice.
    """
    return df.select(*keys, F.inline_outer("facets"))


def facet_profile(rows: DataFrame) -> DataFrame:
    """Counts and mean confidence per kind and detail, with subtotals per kind and a grand total."""
    known = rows.withColumn("detail", F.coalesce("detail", F.lit("-")))
    return known.rollup("kind", "detail").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("confidence").alias("mean_confidence"),
        F.grouping_id().cast("int").alias("level"),
    )
