"""One query per operator over its whole table, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import caps, decontaminate, katz, langid, linededup, packing, preference, repair, secrets, sentencepieces, setjoin, spelling, token_counts

PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Shingles of all texts, as both sides of the containment.
_SHINGLES_SQL = """
    SELECT {key}, len(w) AS n_words, w
    FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})
"""
_SETS_SQL = """
    SELECT DISTINCT {key}, unnest(CASE
        WHEN n_words >= 5 THEN list_transform(range(1, n_words - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN n_words > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM ({words})
"""


def _sets_sql(name: str, key: str) -> str:
    return _SETS_SQL.format(key=key, words=_SHINGLES_SQL.format(key=key, table=name))


OP1_SQL = f"""
WITH d AS ({_sets_sql("documents", "doc_id")}), i AS ({_sets_sql("benchmark", "item_id")}),
    n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
    c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


# All pairs: fit for the sizes at which results are compared.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    link AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
        ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
    least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
    n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON vec_id = least.x LEFT JOIN n ON vec_id = n.x
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE s AS ({_sets_sql("documents", "doc_id")}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (
        SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
    reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
    least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents d JOIN least ON d.doc_id = least.x LEFT JOIN n ON d.doc_id = n.doc_id
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return packed.withColumnsRenamed({"keys": "doc_ids"})


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path(PIECES)
    model = sentencepieces.broadcast_model(spark, path)
    names, log_probs = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))), path, model=model)
    found = langid.predict(docs, path, names, log_probs, model=model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, text))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as chosen; as rejected, itself with the last answer of the conversation with the next id."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    swap = last.join(other, "conv_id").select("conv_id", F.col("last.turn").alias("at"), "other")
    answered = (F.col("turn") == F.col("at")) & (F.col("role") == "assistant")
    rejected = turns.join(swap, "conv_id").withColumn("text", F.when(answered, F.col("other")).otherwise(F.col("text")))
    made = preference.format_preferences(turns, rejected)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


OP8_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    last AS (SELECT conv_id, max(struct_pack(turn := turn, text := text)) AS l FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    swap AS (SELECT a.conv_id, a.l.turn AS place, b.l.text AS other FROM last a JOIN last b ON b.conv_id = a.conv_id + 1),
    r AS (SELECT conv_id, turn, role, CASE WHEN turn = place AND role = 'assistant' THEN coalesce(other, '') ELSE text END AS text FROM t JOIN swap USING (conv_id)),
    a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS no FROM t),
    b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS no FROM r),
    cut AS (
        SELECT conv_id, min(no) AS first_other
        FROM (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.no, b.no) AS no,
                a.no IS NULL OR b.no IS NULL OR a.role <> b.role OR a.text <> b.text AS other
            FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.no = b.no)
        WHERE other GROUP BY conv_id),
    ids AS (SELECT DISTINCT conv_id FROM t),
    shown AS (
        SELECT 'a' AS side, *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM a
        UNION ALL SELECT 'b', *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) FROM b),
    placed AS (
        SELECT shown.*, first_other IS NOT NULL AND no >= first_other AS rest,
            sum(length(s)) OVER (PARTITION BY shown.conv_id, side, first_other IS NOT NULL AND no >= first_other ORDER BY no) AS upto
        FROM shown LEFT JOIN cut USING (conv_id)),
    made AS (
        SELECT conv_id,
            count(*) FILTER (side = 'a' AND NOT rest) AS n_common,
            coalesce(string_agg(s, '' ORDER BY no) FILTER (side = 'a' AND NOT rest), '') AS prompt,
            coalesce(string_agg(s, '' ORDER BY no) FILTER (side = 'a' AND rest), '') AS chosen,
            coalesce(string_agg(s, '' ORDER BY no) FILTER (side = 'b' AND rest), '') AS rejected,
            coalesce(string_agg((upto - length(text) - 11) || ':' || upto, ',' ORDER BY no) FILTER (side = 'a' AND rest AND role = 'assistant'), '') AS chosen_mask,
            coalesce(string_agg((upto - length(text) - 11) || ':' || upto, ',' ORDER BY no) FILTER (side = 'b' AND rest AND role = 'assistant'), '') AS rejected_mask
        FROM placed GROUP BY conv_id)
SELECT * FROM made
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether decoding them gives its text back."""
    coded = sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), check=True)
    return coded.select("doc_id", F.size(sentencepieces.IDS).cast("long").alias("n_pieces"), "same_text", sentencepieces.IDS)


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = katz.held_out(F.col("doc_id"))
    found = katz.score(docs, katz.fit(docs.filter(~out)))
    return found.withColumn("held_out", out)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.misspelled_words(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit_conversations(repair.damage(table(spark, sf_dir, "conversations")), present=F.col("present"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_leaks": op1_benchmark_leaks,
    "op2_near_vectors": op2_near_vectors,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_packing": op5_token_packing,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_preferences": op8_preferences,
    "op9_token_counts": op9_token_counts,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_katz_scores": op11_katz_scores,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op1_benchmark_leaks": OP1_SQL,
    "op2_near_vectors": OP2_SQL,
    "op3_ngram_jaccard": OP3_SQL,
    "op8_preferences": OP8_SQL,
}
