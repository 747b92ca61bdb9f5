"""Catalog runs on a shared folder: a run writes the buckets it touched and becomes visible by its commit entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators.catalog import Catalog
from cairnfield.sources.buckets import BUCKETS, Places, commit_run, latest_run, read_table, write_table

FILES = "path string, content_hash string, size bigint, mtime bigint"
ITEMS = (
    "content_hash string, byte_len bigint, sub_id string, first_run bigint, facet string, format string, width int, "
    "height int, capture_ts timestamp_ntz, indexed_ts timestamp_ntz"
)
QUARANTINE = "path string, size bigint, mtime bigint, error string, failed_run bigint"
EMBEDDINGS = "content_hash string, model string, dim int, vec array<float>"
META = "key string, value string"
SCHEMAS = {"files": FILES, "items": ITEMS, "quarantine": QUARANTINE, "embeddings": EMBEDDINGS}
KEYS = {"files": "path", "items": "content_hash", "quarantine": "path", "embeddings": "content_hash"}


def empty_catalog(spark: SparkSession) -> Catalog:
    return Catalog(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def load_catalog(spark: SparkSession, path: str, run: int | None = None) -> Catalog:
    """One run, by default the newest committed one, or an empty catalog."""
    run = latest_run(spark, path) if run is None else run
    if run is None:
        return empty_catalog(spark)
    places = Places.of(spark, path, run)
    tables = {name: read_table(spark, path, places, name, schema) for name, schema in SCHEMAS.items()}
    # A handful of settings.
    meta = {r["key"]: r["value"] for r in spark.read.schema(META).parquet(f"{path}/run={run}/meta").collect()}
    return Catalog(**tables, meta=meta)


def save_catalog(
    spark: SparkSession, catalog: Catalog | None, path: str, run: int, commit: bool = True, touched: dict[str, DataFrame] | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Write a run and commit it; writing the same run again before its commit replaces it.

    ``touched`` has the keys per table whose rows may differ from the run before (``operators.catalog.touched_keys``);
    only their buckets are written, without it all. Without ``commit`` the run stays invisible until it is committed by
    a call without a catalog.
    """
    if catalog is not None:
        before, after = Places.of(spark, path, latest_run(spark, path)), Places({}, {})
        for name, schema in SCHEMAS.items():
            df = getattr(catalog, name)
            table = _shaped(df if df is not None else spark.createDataFrame([], schema), schema, spark)
            write_table(table, path, before, after, name, KEYS[name], run, None if touched is None else touched[name], buckets)
        after.store(spark, path, run)
        meta = spark.createDataFrame(sorted(catalog.meta.items()), META)
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}/meta")
    if commit:
        commit_run(spark, path, run)


def _shaped(df: DataFrame, schema: str, spark: SparkSession) -> DataFrame:
    fields = spark.createDataFrame([], schema).schema.fields
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])
