"""Newline-delimited JSON event logs with a type tag, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "event"
# Superset of the fields of all event types; a type uses some of them.
EVENT_SCHEMA = (
    "event string, service string, pid bigint, uptime_secs bigint, code int, sub_id string, content_hash string, "
    "path string, change string, ts timestamp_ntz"
)
CORRUPT = "_corrupt"


def parse_events(lines: DataFrame, schema: str = EVENT_SCHEMA, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Well-formed events, and the lines that are not JSON or carry no tag; blank lines are ignored."""
    filled = lines.filter(F.trim(value) != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = filled.withColumn("_e", F.from_json(value, f"{schema}, {CORRUPT} string", options))
    broken = F.col(f"_e.{CORRUPT}").isNotNull() | F.col(f"_e.{TAG}").isNull()
    good = parsed.filter(~broken).select("_e.*").drop(CORRUPT)
    reason = F.when(F.col(f"_e.{CORRUPT}").isNotNull(), "not a valid event").otherwise("no type tag")
    return good, parsed.filter(broken).select(F.col(value).alias("line"), reason.alias("reason"))


def read_events(
    spark: SparkSession, path: str, streaming: bool = False, schema: str = EVENT_SCHEMA, max_files: int = 1024
) -> tuple[DataFrame, DataFrame]:
    """Events below ``path`` and the malformed lines; a stream takes at most ``max_files`` files per batch."""
    if streaming:
        lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    else:
        lines = spark.read.text(path)
    return parse_events(lines, schema)


def event_line(*fields: str, tag: str = TAG) -> Column:
    """One line of the log: the tag first, then the fields in the given order, nulls left out."""
    return F.to_json(F.struct(F.col(tag), *fields), {"ignoreNullFields": "true"})


def write_events(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Append events to a log folder."""
    names = fields or [c for c in df.columns if c != TAG]
    df.select(event_line(*names).alias("value")).write.mode("append").text(path)
