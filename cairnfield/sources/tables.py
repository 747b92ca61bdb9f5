"""Tables read as a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_from_table(df: DataFrame, path_col: str, content_col: str, mtime_col: str | None = None) -> DataFrame:
    """``path, size, mtime, content`` from any table with a path-like and a content column."""
    mtime = F.col(mtime_col).cast("long") if mtime_col else F.lit(None).cast("long")
    return df.select(
        F.col(path_col).alias("path"),
        F.octet_length(content_col).cast("long").alias("size"),
        mtime.alias("mtime"),
        F.col(content_col).alias("content"),
    )
