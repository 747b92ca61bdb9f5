"""Full-text queries over the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnfield.functions.text import tokens
from cairnfield.functions.vectors import cosine
from cairnfield.operators import textsearch as T
from cairnfield.operators.blocks import BlockIndex, build_blocks, search_blocks
from cairnfield.operators.segments import SegmentedIndex
from cairnfield.plans import inputs
from cairnfield.plans.registry import query, table
from cairnfield.session import cut_lineage, shared_folder

WORDS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"

PATHS = """
paths AS (SELECT doc_id, '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, lang FROM documents)"""

INDEX = f"""
toks AS (SELECT doc_id, {WORDS.format('text')} AS t FROM documents),
occ AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks),
lens AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS length FROM toks),
tot AS (SELECT count(*) AS n, avg(length) AS avg_len FROM lens)"""


def _bm25(parts: str, keep: str, limit: str = "") -> str:
    return f"""
WITH {INDEX},
parts AS ({parts}),
dfs AS (SELECT part, count(*) AS df FROM parts GROUP BY 1),
scored AS (SELECT p.doc_id, p.part, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2
             / (tf + 1.2 * (0.25 + 0.75 * length / avg_len)) AS s
  FROM parts p JOIN dfs USING (part) JOIN lens USING (doc_id), tot),
found AS (SELECT doc_id, sum(s) AS score FROM scored GROUP BY doc_id HAVING {keep})
SELECT doc_id, round(-score, 4) AS rank FROM found {limit}"""


def _terms(words: str) -> str:
    return f"SELECT doc_id, term AS part, count(*) AS tf FROM occ WHERE term IN ({words}) GROUP BY 1, 2"


TOP = "ORDER BY found.score DESC, doc_id LIMIT 10"


def _index(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return T.build_postings(docs, "doc_id", ["body"])


def _scan(spark, sf, **match):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return T.scan_text(docs, "doc_id", ["body"], **match)


def _ranked(df):
    return df.select("doc_id", F.round(-F.col("score"), 4).alias("rank"))


@query(
    "fts_fields",
    f"""
WITH {PATHS}
SELECT doc_id, CAST(doc_id AS VARCHAR) || ' txt' AS filename,
       'lib ' || trim(regexp_replace(split_part(path, '/', 3), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' || lang AS text
FROM paths""",
)
def fts_fields(spark, sf):
    docs = inputs.doc_paths(spark, sf).select("doc_id", "path", "lang")
    return T.text_fields(docs, "path", ["lang"]).select("doc_id", "filename", "text")


@query(
    "fts_tokens",
    f"""
WITH {INDEX} SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM toks""",
)
def fts_tokens(spark, sf):
    split = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return split.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    "fts_postings",
    f"""
WITH {INDEX}
SELECT term, doc_id, 'body' AS field, count(*) AS tf, CAST(min(pos) AS INTEGER) AS first_pos,
       CAST(max(pos) AS INTEGER) AS last_pos FROM occ GROUP BY 1, 2""",
)
def fts_postings(spark, sf):
    postings = _index(spark, sf).postings
    ends = [F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos")]
    return postings.select("term", "doc_id", "field", "tf", *ends)


@query("fts_bm25_indexed", _bm25(_terms("'retion', 'whether', 'thion'"), "true", TOP))
def fts_bm25_indexed(spark, sf):
    """The same search over postings, as a stored index has them."""
    best = T.search_text(_index(spark, sf), limit=10, any=["retion", "whether", "thion"])
    return best.select("doc_id", F.round("rank", 4).alias("rank"))


@query("fts_bm25_blocks", _bm25(_terms("'retion', 'whether', 'thion'"), "true", TOP))
def fts_bm25_blocks(spark, sf):
    """The same search over blocks with bounds, which are written first; only those that can hold a result are read."""
    made = build_blocks(_index(spark, sf))
    stored = BlockIndex(cut_lineage(made.blocks), made.texts, made.key)
    best = search_blocks(stored, limit=10, any=["retion", "whether", "thion"])
    return best.select("doc_id", F.round("rank", 4).alias("rank"))


@query("fts_bm25_top10", _bm25(_terms("'retion', 'whether', 'thion'"), "true", TOP))
def fts_bm25_top10(spark, sf):
    found = _scan(spark, sf, any=["retion", "whether", "thion"])
    return _ranked(found.orderBy(F.desc("score"), "doc_id").limit(10))


@query("fts_all_terms", _bm25(_terms("'orre', 'thatin'"), "count(*) = 2"))
def fts_all_terms(spark, sf):
    return _ranked(_scan(spark, sf, all=["orre", "thatin"]))


@query(
    "fts_phrase",
    _bm25(
        """SELECT a.doc_id, 'phrase' AS part, count(*) AS tf FROM occ a JOIN occ b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
           WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1""",
        "true",
    ),
)
def fts_phrase(spark, sf):
    return _ranked(_scan(spark, sf, phrase="of the"))


@query(
    "fts_prefix",
    _bm25("SELECT doc_id, 'prefix' AS part, count(*) AS tf FROM occ WHERE term LIKE 'einach%' GROUP BY 1", "true"),
)
def fts_prefix(spark, sf):
    return _ranked(_scan(spark, sf, prefix="Einach"))


@query(
    "fts_not",
    _bm25(_terms("'der', 'die'"), "doc_id NOT IN (SELECT doc_id FROM occ WHERE term IN ('und', 'von'))"),
)
def fts_not(spark, sf):
    return _ranked(_scan(spark, sf, any=["der", "die"], none=["und", "von"]))


@query(
    "fts_field",
    f"""
WITH {PATHS}
SELECT doc_id FROM paths WHERE split_part(path, '/', 3) = 'src3'""",
)
def fts_field(spark, sf):
    """Words of the folder, not of the file name."""
    docs = T.text_fields(inputs.doc_paths(spark, sf).select("doc_id", "path"))
    index = T.build_postings(docs, "doc_id", ["filename", "text"])
    return T.match_text(index, all=["src3"], field="text").select("doc_id")


REFRESHED = f"""
WITH {INDEX.replace('FROM documents', "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' v2' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 9)")}
SELECT doc_id, count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM occ GROUP BY 1"""


@query("fts_refresh_segments", REFRESHED)
def fts_refresh_segments(spark, sf):
    """The same refresh of a stored index, which is appended to instead of written anew."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    edited = docs.filter(F.col("doc_id") % 10 == 3).withColumn("body", F.concat("body", F.lit(" v2")))
    stored = SegmentedIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "doc_id")
    stored.refresh(_index(spark, sf))
    stored.refresh(T.build_postings(edited, "doc_id", ["body"]), docs.filter(F.col("doc_id") % 10 == 9))
    return stored.read().postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query("fts_refresh", REFRESHED)
def fts_refresh(spark, sf):
    """The index of the earlier documents brought up to date: edited texts rebuilt, vanished ones removed."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    edited = docs.filter(F.col("doc_id") % 10 == 3).withColumn("body", F.concat("body", F.lit(" v2")))
    changed = T.build_postings(edited, "doc_id", ["body"])
    after = T.refresh_postings(_index(spark, sf), changed, docs.filter(F.col("doc_id") % 10 == 9))
    counts = after.postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))
    return counts


@query(
    "hybrid_rank",
    f"""
WITH {INDEX},{inputs.VECTORS},
parts AS ({_terms("'retion', 'whether', 'the'")}),
dfs AS (SELECT part, count(*) AS df FROM parts GROUP BY 1),
words AS (SELECT p.doc_id AS item_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2
            / (tf + 1.2 * (0.25 + 0.75 * length / avg_len))) AS score
  FROM parts p JOIN dfs USING (part) JOIN lens USING (doc_id), tot GROUP BY 1),
looks AS (SELECT v.item_id, list_dot_product(v.vec, q.vec) AS score FROM vectors v JOIN vectors q ON q.item_id = 0 AND v.item_id <> 0),
times AS (SELECT v.item_id, exp(-(CAST(floor(epoch(v.capture_ts)) AS BIGINT) - 1704067200) / 86400.0) AS score
  FROM vectors v WHERE capture_ts IS NOT NULL),
stacked AS (
  SELECT item_id, 0.5 * score / (SELECT max(score) FROM words) AS s FROM words UNION ALL
  SELECT item_id, 0.3 * score / (SELECT max(score) FROM looks) FROM looks UNION ALL
  SELECT item_id, 0.2 * score / (SELECT max(score) FROM times) FROM times)
SELECT item_id, round(sum(s), 4) AS score, count(*) AS evidence FROM stacked GROUP BY 1 ORDER BY sum(s) DESC, item_id LIMIT 10""",
)
def hybrid_rank(spark, sf):
    """Documents close to item 0 in words, looks and time; item and document share their number."""
    words = _scan(spark, sf, any=["retion", "whether", "the"]).withColumnRenamed("doc_id", "item_id")
    items = inputs.vectors(spark, sf)
    asked = items.filter(F.col("item_id") == 0).limit(1).select(F.col("vec").alias("q"), F.lit(64).alias("dim"))
    others = items.filter(F.col("item_id") != 0).withColumn("dim", F.size("vec"))
    looks = others.join(F.broadcast(asked), "dim").select("item_id", cosine(F.col("vec"), F.col("q")).alias("score"))
    age = F.unix_seconds(F.col("capture_ts").cast("timestamp")) - 1704067200
    times = items.filter(F.col("capture_ts").isNotNull()).select("item_id", F.exp(-age / F.lit(86400.0)).alias("score"))
    scores = {"words": words, "looks": looks, "times": times}
    best = T.hybrid_rank(scores, {"words": 0.5, "looks": 0.3, "times": 0.2}, "item_id", 10)
    return best.select("item_id", F.round("score", 4).alias("score"), "evidence")
