"""From raw documents to piece ids: the stages of a training corpus, one operator each.

A stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import decontaminate, langid, linededup, sentencepieces, setjoin
from cairnfield.llm.queries import PIECES, table
from cairnfield.llm.work import Step

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5  # a language is accepted if it is likelier than all others together


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language; those without a letter, or with an unclear language, go."""
    path = public_tokenizers.path(PIECES)
    model = sentencepieces.broadcast_model(spark, path)
    names, log_probs = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))), path, model=model)
    found = langid.predict(docs, path, names, log_probs, model=model, keep=COLUMNS[1:])
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of texts; every document stays here, also one that is left without lines."""
    found = linededup.dedup_lines(docs, keep=["lang", "source"])
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    found = setjoin.jaccard_components(docs)
    copies = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(COLUMNS)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that has text left.

    All documents had a letter when their language was found. One that is blank now has lost every line to earlier
    documents, as an exact copy does.
    """
    left = docs.filter(F.col("text").isNull() | (F.trim(F.translate("text", "\t\r\n", "   ")) != ""))
    coded = sentencepieces.encode(left, public_tokenizers.path(PIECES), keep=["doc_id", "lang", "source"])
    return coded.withColumn("n_pieces", F.size(sentencepieces.IDS).cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", join_near_copies),
    ("decontamination", remove_leaks),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None  # SQL cannot express the first and the last stage; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Step(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
