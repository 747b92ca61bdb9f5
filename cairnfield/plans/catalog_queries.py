"""Catalog queries over two snapshots of the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.identity import content_hash
from cairnfield.functions.text import tokens
from cairnfield.operators import catalog as C
from cairnfield.plans import inputs
from cairnfield.plans.ingest import Embedder, ingest, read_from
from cairnfield.plans.registry import query, table
from cairnfield.session import shared_folder
from cairnfield.sources.catalog_store import load_catalog
from cairnfield.sources.tables import corpus_from_table

READABLE_FROM = 50  # shorter texts stand for undecodable files
CAP = 20_000

PREV_TABLES = f"""
prev AS (SELECT path, 'sha256:' || sha256(content) AS content_hash, size, mtime
         FROM corpus_prev WHERE size >= {READABLE_FROM}),
held AS (SELECT path, size, mtime, 'unreadable' AS error, CAST(1 AS BIGINT) AS failed_run
         FROM corpus_prev WHERE size < {READABLE_FROM})"""

CHANGES = f"""{inputs.CORPUS_PREV},{inputs.CORPUS_CUR},{PREV_TABLES},
known AS (SELECT DISTINCT content_hash FROM prev),
staged AS (
  SELECT c.path, c.size, c.mtime, 'sha256:' || sha256(c.content) AS content_hash, c.size >= {READABLE_FROM} AS readable,
         p.path IS NOT NULL AS had_prior, p.content_hash AS prior_hash,
         CASE WHEN p.size = c.size AND p.mtime = c.mtime THEN 'Unchanged'
              WHEN h.size = c.size AND h.mtime = c.mtime THEN 'Skipped'
              WHEN c.size > {CAP} THEN 'Failed' END AS early
  FROM corpus_cur c LEFT JOIN prev p ON p.path = c.path LEFT JOIN held h ON h.path = c.path),
firsts AS (SELECT content_hash, min(path) AS first_path FROM staged WHERE early IS NULL AND readable GROUP BY 1),
changes AS (
  SELECT s.path, s.size, s.mtime, s.content_hash, s.prior_hash, s.had_prior,
         CASE WHEN early IS NOT NULL THEN early
              WHEN k.content_hash IS NOT NULL AND s.prior_hash = s.content_hash THEN 'Unchanged'
              WHEN k.content_hash IS NULL AND NOT readable THEN 'Failed'
              WHEN had_prior THEN 'Updated'
              WHEN k.content_hash IS NOT NULL THEN 'Deduped'
              WHEN s.path = f.first_path THEN 'Indexed' ELSE 'Deduped' END AS outcome
  FROM staged s LEFT JOIN known k ON k.content_hash = s.content_hash
       LEFT JOIN firsts f ON f.content_hash = s.content_hash),
removed AS (
  SELECT p.* FROM prev p LEFT JOIN changes c ON c.path = p.path
  WHERE c.path IS NULL OR c.outcome = 'Skipped' OR (c.outcome = 'Failed' AND c.size > {CAP}))"""


def previous(spark: SparkSession, sf: str) -> C.Catalog:
    """The catalog as it stood after the earlier snapshot."""
    before = inputs.corpus_prev(spark, sf)
    stat = before.select("path", content_hash(F.col("content")).alias("content_hash"), "size", "mtime")
    files = stat.filter(F.col("size") >= READABLE_FROM)
    items = C.dedup_items(files).select("content_hash", "byte_len", F.lit(1).cast("long").alias("first_run"))
    held = stat.filter(F.col("size") < READABLE_FROM).select(
        "path", "size", "mtime", F.lit("unreadable").alias("error"), F.lit(1).cast("long").alias("failed_run")
    )
    return C.Catalog(files, items, held, None, {"embed_model": "pixels-160", "schema_version": "1"})


def current_scan(spark: SparkSession, sf: str) -> DataFrame:
    after = inputs.corpus_cur(spark, sf)
    return after.select(
        "path",
        "size",
        "mtime",
        content_hash(F.col("content")).alias("content_hash"),
        (F.col("size") >= READABLE_FROM).alias("readable"),
    )


def _run(spark: SparkSession, sf: str):
    return C.apply_scan(previous(spark, sf), current_scan(spark, sf), "/lib/", 2, CAP)


@query(
    "corpus_scan",
    """
SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, length(text) AS size,
       sha256(text) AS digest FROM documents
UNION ALL
SELECT '/web/' || CAST(page_id AS VARCHAR) || '.html', length(html), sha256(html) FROM pages""",
)
def corpus_scan(spark, sf):
    docs = inputs.doc_paths(spark, sf)
    pages = table(spark, sf, "pages").withColumn("path", F.format_string("/web/%d.html", "page_id"))
    both = corpus_from_table(docs, "path", "content").unionByName(corpus_from_table(pages, "path", "html"))
    return both.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))


@query(
    "content_identity",
    """
SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, 'sub:item/img_' || substr(sha256(text), 1, 12) AS sub_id
FROM documents""",
)
def content_identity(spark, sf):
    docs = C.with_content_id(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", "content_hash", "sub_id")


@query(
    "dedup_items",
    """
SELECT 'sha256:' || sha256(text) AS content_hash, count(*) AS n_files,
       min('/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt') AS path, max(length(text)) AS byte_len
FROM documents GROUP BY 1""",
)
def dedup_items(spark, sf):
    files = C.with_content_id(inputs.doc_paths(spark, sf)).withColumn("size", F.length("content").cast("long"))
    return C.dedup_items(files)


@query(
    "item_brief",
    f"""
WITH {inputs.CORPUS_PREV},{inputs.CORPUS_CUR}
SELECT i.content_hash, coalesce(f.path, '') AS path
FROM (SELECT DISTINCT 'sha256:' || sha256(content) AS content_hash FROM corpus_prev) i
LEFT JOIN (SELECT 'sha256:' || sha256(content) AS content_hash, min(path) AS path FROM corpus_cur GROUP BY 1) f
  ON f.content_hash = i.content_hash""",
)
def item_brief(spark, sf):
    items = C.with_content_id(inputs.corpus_prev(spark, sf)).select("content_hash").distinct()
    return C.representative_path(items, C.with_content_id(inputs.corpus_cur(spark, sf)))


@query("change_classify", f"WITH {CHANGES} SELECT path, content_hash, prior_hash, outcome FROM changes")
def change_classify(spark, sf):
    changes = C.classify_changes(current_scan(spark, sf), previous(spark, sf), CAP)
    return changes.select("path", "content_hash", "prior_hash", "outcome")


@query(
    "stat_cache_misses",
    f"""
WITH {inputs.CORPUS_PREV},{inputs.CORPUS_CUR}
SELECT c.path, c.size, c.mtime FROM corpus_cur c
WHERE NOT EXISTS (SELECT 1 FROM corpus_prev p WHERE p.path = c.path AND p.size = c.size AND p.mtime = c.mtime)""",
)
def stat_cache_misses(spark, sf):
    before = previous(spark, sf)
    listing = inputs.corpus_cur(spark, sf).select("path", "size", "mtime")
    return C.needs_read(listing, before.files, before.quarantine)


@query("delete_sweep", f"WITH {CHANGES} SELECT path, content_hash FROM removed")
def delete_sweep(spark, sf):
    _, _, removed = _run(spark, sf)
    return removed.select("path", "content_hash")


MERGED = f"""{CHANGES},
placed AS (SELECT path, content_hash, size, mtime FROM changes WHERE outcome NOT IN ('Failed', 'Skipped')),
files AS (
  SELECT path, content_hash, size, mtime FROM placed
  UNION ALL
  SELECT p.path, p.content_hash, p.size, p.mtime FROM prev p
  WHERE p.path NOT IN (SELECT path FROM placed) AND p.path NOT IN (SELECT path FROM removed)
    AND p.path NOT IN (SELECT path FROM changes WHERE outcome = 'Failed' AND had_prior AND size <= {CAP}))"""


@query(
    "orphan_gc",
    f"WITH {MERGED} SELECT DISTINCT content_hash FROM prev WHERE content_hash NOT IN (SELECT content_hash FROM files)",
)
def orphan_gc(spark, sf):
    after, _, _ = _run(spark, sf)
    return C.orphans(previous(spark, sf).items, after.files).select("content_hash")


@query("catalog_merge", f"WITH {MERGED} SELECT path, content_hash, size, mtime FROM files")
def catalog_merge(spark, sf):
    after, _, _ = _run(spark, sf)
    return after.files.select("path", "content_hash", "size", "mtime")


@query(
    "quarantine_upsert",
    f"""
WITH {CHANGES}
SELECT path, size, mtime, CASE WHEN size > {CAP} THEN 'too large' ELSE 'unreadable' END AS error,
       CAST(2 AS BIGINT) AS failed_run FROM changes WHERE outcome = 'Failed'
UNION ALL
SELECT h.path, h.size, h.mtime, h.error, h.failed_run FROM held h
JOIN corpus_cur c ON c.path = h.path AND c.size = h.size AND c.mtime = h.mtime""",
)
def quarantine_upsert(spark, sf):
    after, _, _ = _run(spark, sf)
    return after.quarantine


@query(
    "size_cap_split",
    f"""
SELECT doc_id, n_chars AS size, CASE WHEN n_chars > {CAP} THEN 'byte cap' END AS error FROM documents""",
)
def size_cap_split(spark, sf):
    sized = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("size"))
    ok, failed = C.split_by_size(sized, CAP)
    return ok.unionByName(failed, allowMissingColumns=True)


@query(
    "scan_report",
    f"""
WITH {CHANGES}
SELECT count(*) FILTER (outcome = 'Indexed') AS indexed, count(*) FILTER (outcome = 'Updated') AS updated,
       count(*) FILTER (outcome = 'Deduped') AS deduped, count(*) FILTER (outcome = 'Unchanged') AS unchanged,
       count(*) FILTER (outcome = 'Failed') AS failed, (SELECT count(*) FROM removed) AS removed
FROM changes""",
)
def scan_report(spark, sf):
    _, changes, removed = _run(spark, sf)
    return C.scan_report(changes, removed)


@query(
    "catalog_stats",
    f"""
WITH {inputs.CORPUS_PREV},{PREV_TABLES}
SELECT (SELECT count(DISTINCT content_hash) FROM prev) AS items, (SELECT count(*) FROM prev) AS files,
       (SELECT count(*) FROM held) AS failed, (SELECT count(*) FROM embeddings) AS embeddings,
       '1' AS schema_version, 'pixels-160' AS embed_model""",
)
def catalog_stats(spark, sf):
    before = previous(spark, sf)
    vectors = table(spark, sf, "embeddings").select("vec_id")
    return C.catalog_stats(C.Catalog(before.files, before.items, before.quarantine, vectors, before.meta))


@query(
    "recent_items",
    """
WITH files AS (
  SELECT 'sha256:' || sha256(text) AS content_hash, '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
         e.ts FROM documents JOIN events e ON e.event_id = doc_id)
SELECT content_hash, max(ts) AS indexed_ts, min(path) AS path FROM files
GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 50""",
)
def recent_items(spark, sf):
    times = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    files = C.with_content_id(inputs.doc_paths(spark, sf)).join(times, "doc_id")
    files = files.select("content_hash", "path", "ts")
    items = files.groupBy("content_hash").agg(F.max("ts").alias("indexed_ts"))
    return C.list_items(items, files, 50)


@query(
    "path_lookup",
    f"""
WITH {inputs.CORPUS_PREV},{inputs.CORPUS_CUR},{PREV_TABLES}
SELECT path, content_hash, (SELECT max(size) FROM prev x WHERE x.content_hash = prev.content_hash) AS byte_len
FROM prev WHERE path IN (SELECT path FROM corpus_cur)""",
)
def path_lookup(spark, sf):
    before = previous(spark, sf)
    wanted = inputs.corpus_cur(spark, sf).select("path")
    return C.item_for_path(before.files, before.items, wanted).select("path", "content_hash", "byte_len")


@query(
    "move_detect",
    f"""
WITH {inputs.CORPUS_PREV},{inputs.CORPUS_CUR},
gone AS (SELECT sha256(content) AS h, count(*) AS n, min(path) AS path FROM corpus_prev
         WHERE path NOT IN (SELECT path FROM corpus_cur) GROUP BY 1),
came AS (SELECT sha256(content) AS h, count(*) AS n, min(path) AS path FROM corpus_cur
         WHERE path NOT IN (SELECT path FROM corpus_prev) GROUP BY 1)
SELECT 'sha256:' || gone.h AS content_hash, gone.n AS n_removed, gone.path AS from_path, came.n AS n_added,
       came.path AS to_path FROM gone JOIN came ON came.h = gone.h""",
)
def move_detect(spark, sf):
    prev, cur = (C.with_content_id(f(spark, sf)) for f in (inputs.corpus_prev, inputs.corpus_cur))
    return C.detect_moves(prev.select("path", "content_hash"), cur.select("path", "content_hash"))


@query(
    "capture_time_parse",
    """
WITH stamps AS (
  SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m,
         CASE WHEN o_orderkey % 5 = 0 THEN 31 + CAST(o_orderkey % 2 AS INTEGER) ELSE day(o_orderdate) END AS d,
         CAST(o_orderkey % 24 AS BIGINT) AS h FROM orders)
SELECT o_orderkey, CASE WHEN d <= 31 THEN
         CAST(epoch(make_date(y, m, 1)) AS BIGINT) + (d - 1) * 86400 + h * 3600 + 5 * 60 + 7 END AS capture_ts
FROM stamps""",
)
def capture_time_parse(spark, sf):
    key = F.col("o_orderkey")
    day = F.when(key % 5 == 0, F.lit(31) + (key % 2)).otherwise(F.dayofmonth("o_orderdate"))
    stamp = F.format_string(
        "%04d:%02d:%02d %02d:05:07", F.year("o_orderdate"), F.month("o_orderdate"), day.cast("int"), (key % 24).cast("int")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", stamp.alias("stamp"))
    return C.capture_times(orders, "stamp").select("o_orderkey", "capture_ts")


@query(
    "semantic_address",
    """
WITH described AS (
  SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, e.ts, lang, source,
         list_distinct(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS terms
  FROM documents JOIN events e ON e.event_id = doc_id),
scored AS (SELECT path, CAST(len(list_intersect(terms, ['the', 'and', 'thtion', 'reter', 'ing'])) AS BIGINT) AS evidence
  FROM described WHERE lang = 'en' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20' AND source = 'src7')
SELECT path, evidence FROM scored WHERE evidence > 0 ORDER BY evidence DESC, path LIMIT 10""",
)
def semantic_address(spark, sf):
    times = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    described = inputs.doc_paths(spark, sf).join(times, "doc_id")
    described = described.select(
        "path",
        "ts",
        F.array("lang").alias("facets"),
        F.array("source").alias("entities"),
        F.array_distinct(tokens(F.col("content"))).alias("terms"),
    )
    found = C.resolve_address(
        described, "en", ("2024-01-01 00:00:00", "2024-01-20 00:00:00"), "src7", "the and thtion reter ing", 10
    )
    return found.select("path", "evidence")


@query(
    "snapshot_set_ops",
    f"""
WITH {inputs.CORPUS_PREV},{inputs.CORPUS_CUR}
SELECT coalesce(c.path, p.path) AS path,
       CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'common' END AS change
FROM corpus_prev p FULL JOIN corpus_cur c ON c.path = p.path""",
)
def snapshot_set_ops(spark, sf):
    return C.snapshot_diff(inputs.corpus_prev(spark, sf), inputs.corpus_cur(spark, sf))


def _ingested(spark: SparkSession, sf: str) -> str:
    """A store after a run over the earlier and one over the later snapshot."""

    def shape(content) -> list[float]:
        """A stand-in for a model: three numbers of a text; an empty one fails."""
        if not content:
            raise ValueError("empty")
        return [float(len(content)), float(content.count(" ")), float(content.count("e"))]

    store = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    for run, corpus in ((1, inputs.corpus_prev(spark, sf)), (2, inputs.corpus_cur(spark, sf))):
        ingest(spark, corpus, read_from(corpus), store, run, "/lib/", Embedder("shape-3", 3, shape), F.lit("2024-01-31"), CAP)
    return store


@query(
    "ingest_incremental",
    f"""
WITH {inputs.CORPUS_PREV},{inputs.CORPUS_CUR},
now AS (SELECT path, 'sha256:' || sha256(content) AS content_hash, size, mtime, content FROM corpus_cur WHERE size BETWEEN 1 AND {CAP}),
old AS (SELECT DISTINCT 'sha256:' || sha256(content) AS content_hash FROM corpus_prev WHERE size BETWEEN 1 AND {CAP})
SELECT path, now.content_hash, size, mtime, CAST(CASE WHEN old.content_hash IS NULL THEN 2 ELSE 1 END AS BIGINT) AS first_run,
       CAST(length(content) AS DOUBLE) AS first_number
FROM now LEFT JOIN old ON old.content_hash = now.content_hash""",
)
def ingest_incremental(spark, sf):
    """Files, the run that brought their content, and its embedding, after two runs of the ingest job."""
    found = load_catalog(spark, _ingested(spark, sf))
    items = found.items.select("content_hash", "first_run")
    vectors = found.embeddings.select("content_hash", F.element_at("vec", 1).cast("double").alias("first_number"))
    return found.files.join(items, "content_hash").join(vectors, "content_hash", "left")
