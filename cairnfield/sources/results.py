"""Results as text, and open-format export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render_hits(hits: DataFrame, fmt: str = "table") -> DataFrame:
    """One ``line`` per hit: JSON, or ``score  id  path`` with four decimals (no score column: ``id  path``)."""
    if fmt == "json":
        fields = [c for c in ("sub_id", "path", "score", "capture_ts") if c in hits.columns]
        return hits.select(F.to_json(F.struct(*fields)).alias("line"))
    if "score" in hits.columns:
        return hits.select(F.format_string("%.4f  %s  %s", F.col("score").cast("double"), "sub_id", "path").alias("line"))
    return hits.select(F.format_string("%s  %s", "sub_id", "path").alias("line"))


def export_layers(layers: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write each named layer to its own folder as parquet or JSON lines."""
    for name, df in layers.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/layer={name}")
