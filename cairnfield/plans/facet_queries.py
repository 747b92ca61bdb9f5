"""Facet queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnfield.functions import facets as P
from cairnfield.operators import facets as O
from cairnfield.plans import inputs
from cairnfield.plans.registry import query, table
from cairnfield.sources.tables import corpus_from_table

# Extensions are spread over the corpus so that every rule meets real text.
EXTENSIONS = ["txt", "md", "json", "csv", "yaml", "xml", "svg", "py", "docx", "bin", "log", "rs", ""]

FILES = f"""
files AS (
  SELECT '/lib/' || CAST(doc_id AS VARCHAR) || '.' || list_extract({EXTENSIONS!r}, CAST(doc_id % 13 AS INTEGER) + 1) AS path,
         CASE doc_id % 17 WHEN 1 THEN '#!/usr/bin/env python' || chr(10) || text
              WHEN 2 THEN 'BM' || text WHEN 3 THEN '%PDF-' || text
              WHEN 4 THEN '# T' || chr(10) || '- [ ] a' || chr(10) || '- b' || chr(10) || text
              WHEN 5 THEN 'a,b' || chr(10) || '1,2' || chr(10) || '3,4' || chr(10) || '5,6' || chr(10) || '7,8' || chr(10) || text
              WHEN 6 THEN 'import x' || chr(10) || 'def f() {{return 1;}}' || chr(10) || text
              WHEN 7 THEN '{{"a": 1}}' || text ELSE text END AS content,
         list_extract({EXTENSIONS!r}, CAST(doc_id % 13 AS INTEGER) + 1) AS ext
  FROM documents
  UNION ALL
  SELECT '/web/' || CAST(page_id AS VARCHAR) || '.html', html, 'html' FROM pages)"""

_SPACE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_IN = rf"[\t\x0B\f\r {_SPACE}]*"
_MARKS = " + ".join(f"CAST(contains(content, '{m}') AS INTEGER)" for m in P.CODE_MARKERS)

SIGNALS_OF = f"""
signals AS (
  SELECT path, ext, content,
    CASE WHEN starts_with(content, 'BM') THEN 'bmp' WHEN starts_with(content, '%PDF-') THEN 'pdf' END AS magic,
    length(content) > 0 AND length(regexp_replace(content, '[^\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g'))
       < 0.02 * length(content) AS texty,
    CASE WHEN starts_with(content, '#!') THEN 'python' END AS script,
    {_MARKS} >= 2 AND length(regexp_replace(content, '[^{{}};]', '', 'g')) >= 3 AS codey,
    regexp_matches(content, '(?m)^##? ') AND (contains(content, '](')
       OR len(regexp_extract_all(content, '(?m)^{_IN}- ')) >= 2) AS marked,
    (starts_with(ltrim(content), '{{') AND contains(content, '":'))
       OR (starts_with(ltrim(content), '[') AND contains(content, '{{')) AS jsony,
    regexp_matches(content, '(?m)^{_IN}([-*] )?\\[[ x]\\]') AS boxes,
    len(regexp_extract_all(content, '[^\\s\\x0B{_SPACE}]+')) >= 8 AND regexp_matches(content, '[.!?]') AS prosy,
    [len(string_split(l, ',')) - 1 FOR l IN list_filter(string_split(content, chr(10)),
        lambda x: regexp_matches(x, '[^\\s\\x0B{_SPACE}]'))][1:5] AS commas
  FROM files)"""

SIGNALS = f"{FILES},{SIGNALS_OF}"


def _csvy() -> str:
    return "(len(commas) >= 2 AND list_min(commas) >= 1 AND list_min(commas) = list_max(commas))"


_BY_EXT = " UNION ALL ".join(
    f"SELECT '{e}' AS ext, '{k}' AS kind, {c}::DOUBLE AS confidence, {repr(d) if d else 'NULL'} AS detail"
    for e, k, c, d in P.EXTENSION_FACETS
    if e in EXTENSIONS
) + " UNION ALL ".join(
    ["", *[f"SELECT '{e}', 'code', 0.85, '{lang}'" for e, lang in (("py", "python"), ("rs", "rust"), ("html", "html"))]]
)

RESOLVED_OF = f"""{SIGNALS_OF},
by_ext AS ({_BY_EXT}),
lang AS (SELECT * FROM (VALUES ('py', 'python'), ('rs', 'rust'), ('html', 'html')) AS t(ext, language)),
readable AS (SELECT s.*, l.language,
    l.language IS NOT NULL OR script IS NOT NULL OR codey AS is_code,
    ext IN ('json', 'csv', 'yaml') OR jsony OR {_csvy()} AS is_data
  FROM signals s LEFT JOIN lang l USING (ext) WHERE texty AND magic IS NULL),
candidates AS (
  SELECT path, 1 AS ord, CASE magic WHEN 'bmp' THEN 'image' ELSE 'pdf' END AS kind,
         CASE magic WHEN 'bmp' THEN 0.9 ELSE 0.99 END::DOUBLE AS confidence, magic AS detail FROM signals WHERE magic IS NOT NULL
  UNION ALL SELECT path, 2, kind, confidence, detail FROM signals JOIN by_ext USING (ext)
  UNION ALL SELECT path, 3, 'code', CASE WHEN language IS NOT NULL THEN 0.9 WHEN script IS NOT NULL THEN 0.85 ELSE 0.65 END,
         coalesce(language, script) FROM readable WHERE is_code
  UNION ALL SELECT path, 4, 'markdown', CASE WHEN ext = 'md' THEN 0.9 ELSE 0.6 END, NULL FROM readable WHERE ext = 'md' OR marked
  UNION ALL SELECT path, 5, 'data',
         CASE WHEN ext = 'json' OR jsony THEN 0.8 WHEN ext = 'csv' OR {_csvy()} THEN 0.7 ELSE 0.8 END,
         CASE WHEN ext = 'json' OR jsony THEN 'json' WHEN ext = 'csv' OR {_csvy()} THEN 'csv' ELSE ext END FROM readable WHERE is_data
  UNION ALL SELECT path, 6, 'todo', 0.8, NULL FROM readable WHERE boxes
  UNION ALL SELECT path, 7, 'text', 0.6, NULL FROM readable
  UNION ALL SELECT path, 8, 'notes', 0.6, NULL FROM readable WHERE NOT is_code AND NOT is_data AND prosy),
merged AS (SELECT path, kind, max(confidence) AS confidence, arg_min(detail, ord) FILTER (detail IS NOT NULL) AS detail
  FROM candidates GROUP BY 1, 2),
resolved AS (SELECT * FROM merged UNION ALL
  SELECT path, 'binary', 0.5, NULL FROM files WHERE path NOT IN (SELECT path FROM merged))"""

RESOLVED = f"{FILES},{RESOLVED_OF}"


def _files(spark, sf):
    """Documents under many extensions, some opened like scripts, lists, tables or binary files, and all pages."""
    doc = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (doc % 13 + 1).cast("int"))
    n = doc % 17

    def opened(start):
        return F.concat(F.lit(start), F.col("text"))

    content = (
        F.when(n == 1, opened("#!/usr/bin/env python\n"))
        .when(n == 2, opened("BM"))
        .when(n == 3, opened("%PDF-"))
        .when(n == 4, opened("# T\n- [ ] a\n- b\n"))
        .when(n == 5, opened("a,b\n1,2\n3,4\n5,6\n7,8\n"))
        .when(n == 6, opened("import x\ndef f() {return 1;}\n"))
        .when(n == 7, opened('{"a": 1}'))
        .otherwise(F.col("text"))
    )
    path = F.concat(F.lit("/lib/"), doc.cast("string"), F.lit("."), ext)
    docs = table(spark, sf, "documents").select(path.alias("path"), content.alias("content"))
    pages = table(spark, sf, "pages").withColumn("path", F.format_string("/web/%d.html", "page_id"))
    both = corpus_from_table(docs, "path", "content").unionByName(corpus_from_table(pages, "path", "html"))
    return both.select("path", "content")


def _resolved(spark, sf):
    return O.resolve_facets(_files(spark, sf))


def _flag(name, sql, column):
    @query(name, f"WITH {SIGNALS} SELECT path, coalesce({sql}, false) AS flag FROM signals")
    def run(spark, sf):
        return _files(spark, sf).select("path", column(F.col("content")).alias("flag"))

    return run


_flag("is_text", "texty", P.is_text)
_flag("facet_code", "codey", P.looks_like_code)
_flag("facet_markdown", "marked", P.looks_like_markdown)
_flag("facet_todo", "boxes", P.has_checkboxes)
_flag("facet_notes", "prosy", P.looks_like_prose)


@query("facet_json_csv", f"WITH {SIGNALS} SELECT path, jsony AS looks_json, coalesce({_csvy()}, false) AS looks_csv FROM signals")
def facet_json_csv(spark, sf):
    text = F.col("content")
    looks = P.looks_like_json(text).alias("looks_json"), P.looks_like_csv(text).alias("looks_csv")
    return _files(spark, sf).select("path", *looks)


@query(
    "facet_magic",
    f"""
WITH {SIGNALS} SELECT path, CASE magic WHEN 'bmp' THEN 'image' WHEN 'pdf' THEN 'pdf' END AS kind, magic AS detail FROM signals""",
)
def facet_magic(spark, sf):
    sniffed = _files(spark, sf).select("path", P.sniff(F.col("content")).alias("m"))
    return sniffed.select("path", F.col("m.kind").alias("kind"), F.col("m.detail").alias("detail"))


@query("facet_extension", f"WITH {RESOLVED} SELECT path, kind, confidence, detail FROM signals JOIN by_ext USING (ext)")
def facet_extension(spark, sf):
    known = O.extension_facets(_files(spark, sf).select("path"))
    return known.select("path", F.inline("by_extension"))


@query("facet_shebang", f"WITH {SIGNALS} SELECT path, script AS language FROM signals")
def facet_shebang(spark, sf):
    return _files(spark, sf).select("path", P.shebang_lang(F.col("content")).alias("language"))


@query("facet_resolve", f"WITH {RESOLVED} SELECT path, kind, confidence, detail FROM resolved")
def facet_resolve(spark, sf):
    return O.facet_rows(_resolved(spark, sf), "path")


@query("facet_primary", f"WITH {RESOLVED} SELECT path, arg_max(kind, (confidence, kind)) AS kind FROM resolved GROUP BY 1")
def facet_primary(spark, sf):
    return _resolved(spark, sf).select("path", P.primary_facet(F.col("facets")).alias("kind"))


@query(
    "facet_summary_line",
    f"""
WITH {RESOLVED}
SELECT path, string_agg(kind || coalesce(':' || detail, '') || ' ' || printf('%.2f', confidence), ', '
                        ORDER BY confidence DESC, kind) AS line FROM resolved GROUP BY 1""",
)
def facet_summary_line(spark, sf):
    return _resolved(spark, sf).select("path", P.summary_line(F.col("facets")).alias("line"))


@query(
    "facet_refined",
    f"""
WITH {RESOLVED},
extra AS (SELECT path, 'article' AS kind, 0.7::DOUBLE AS confidence FROM files WHERE contains(content, '<article'))
SELECT path, string_agg(kind, ',' ORDER BY confidence DESC, late, kind) AS kinds
FROM (SELECT path, kind, confidence, 0 AS late FROM resolved UNION ALL SELECT path, kind, confidence, 1 FROM extra) GROUP BY 1""",
)
def facet_refined(spark, sf):
    def refiner(df):
        article = F.contains("content", F.lit("<article"))
        return df.withColumn("extra", F.when(article, F.array(P.facet("article", 0.7))))

    refined = O.resolve_with(_files(spark, sf), refiner)
    return refined.select("path", F.array_join(F.transform("facets", lambda f: f["kind"]), ",").alias("kinds"))


@query(
    "facet_profile",
    f"""
WITH {RESOLVED}
SELECT kind, detail, count(*) AS n, round(avg(confidence), 4) AS mean_confidence,
       CAST(grouping_id(kind, detail) AS INTEGER) AS level
FROM (SELECT kind, coalesce(detail, '-') AS detail, confidence FROM resolved) GROUP BY ROLLUP (kind, detail)""",
)
def facet_profile(spark, sf):
    profile = O.facet_profile(O.facet_rows(_resolved(spark, sf), "path"))
    return profile.withColumn("mean_confidence", F.round("mean_confidence", 4))
