"""The journal as JSON lines, one event per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL_SCHEMA = (
    "seq bigint, ts timestamp_ntz, actor string, capability string, inputs array<string>, outputs array<string>, "
    "reversibility struct<kind:string,inverse:string,consent:struct<staged_summary:string,confirmed_seq:bigint>>, "
    "engine string"
)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All events; blank lines are skipped. Order by ``seq`` for the log order."""
    return spark.read.schema(JOURNAL_SCHEMA).json(path)


def write_journal(df: DataFrame, path: str) -> None:
    """Append numbered events."""
    df.write.mode("append").json(path)


def flat_journal(df: DataFrame) -> DataFrame:
    """The columns the journal operators use, from the nested log."""
    how = "reversibility"
    return df.select(
        "seq", "ts", "actor", "capability", "inputs", "outputs", "engine",
        F.col(f"{how}.kind").alias("kind"),
        F.col(f"{how}.consent.confirmed_seq").alias("consent_seq"),
        F.col(f"{how}.inverse").alias("inverse"),
    )
