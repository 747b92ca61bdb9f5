"""Tables in hash buckets of a key: a run writes the buckets whose rows changed and refers to older runs for the others."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32  # of a new table; choose more for large ones, so that a bucket stays below some hundred thousand rows
BUCKET = "bucket"
PLACES = "name string, buckets int, bucket int, run bigint"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def latest_run(spark: SparkSession, store: str) -> int | None:
    """Number of the newest committed run, none for a new store."""
    try:
        commits = spark.read.schema("run bigint").parquet(f"{store}/commits")
    except AnalysisException:
        return None
    return commits.agg(F.max("run")).first()[0]


def commit_run(spark: SparkSession, store: str, run: int) -> None:
    spark.range(run, run + 1).select(F.col("id").alias("run")).coalesce(1).write.mode("append").parquet(f"{store}/commits")


class Places:
    """Which run holds each bucket of each table; at most one entry per table and bucket."""

    def __init__(self, counts: dict[str, int], runs: dict[str, dict[int, int]]):
        self.counts, self.runs = counts, runs

    @staticmethod
    def of(spark: SparkSession, store: str, run: int | None) -> Places:
        """As the given run left it; empty for a new store."""
        found = Places({}, {})
        if run is None:
            return found
        for row in spark.read.schema(PLACES).parquet(f"{store}/run={run}/places").collect():
            found.counts[row["name"]] = row["buckets"]
            held = found.runs.setdefault(row["name"], {})
            if row["bucket"] is not None:
                held[row["bucket"]] = row["run"]
        return found

    def store(self, spark: SparkSession, store: str, run: int) -> None:
        rows = [(name, count, None, None) for name, count in self.counts.items()]
        rows += [(name, self.counts[name], b, r) for name, held in self.runs.items() for b, r in held.items()]
        spark.createDataFrame(rows, PLACES).coalesce(1).write.mode("overwrite").parquet(f"{store}/run={run}/places")


def _asked(touched: DataFrame, key: str, count: int) -> set[int]:
    # At most one row per bucket.
    return {r[0] for r in touched.select(bucket_of(key, count).alias(BUCKET)).distinct().collect()}


def read_table(
    spark: SparkSession, store: str, places: Places, name: str, schema: str, wanted: DataFrame | None = None, key: str | None = None
) -> DataFrame:
    """The table, or with ``wanted`` those of its buckets alone that hold such values of ``key``."""
    held = places.runs.get(name, {})
    if wanted is not None and held:
        asked = _asked(wanted, key, places.counts[name])
        held = {b: r for b, r in held.items() if b in asked}
    folders = [f"{store}/run={r}/{name}/{BUCKET}={b}" for b, r in sorted(held.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_table(
    df: DataFrame, store: str, before: Places, after: Places, name: str, key: str, run: int, touched: DataFrame | None = None, buckets: int = BUCKETS
) -> None:
    """Write the buckets of ``df`` that hold keys of ``touched`` (without it all) as run ``run``, and enter them in ``after``.

    ``df`` has all rows of those buckets; what it has of others isn't written, they stay as ``before`` has them. The
    number of buckets stays as the table began. A repeated run overwrites itself.
    """
    spark = df.sparkSession
    count = before.counts.get(name, buckets)
    kept = {}
    rows = df.withColumn(BUCKET, bucket_of(key, count))
    if touched is not None:
        asked = _asked(touched, key, count)
        kept = {b: r for b, r in before.runs.get(name, {}).items() if b not in asked}
        rows = rows.filter(F.col(BUCKET).isin(*asked)) if asked else rows.limit(0)
    folder = f"{store}/run={run}/{name}"
    rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
    written = spark.read.schema(f"{BUCKET} int").parquet(folder).select(BUCKET).distinct().collect()
    after.counts[name] = count
    after.runs[name] = {**kept, **{r[0]: run for r in written}}


def clean_runs(spark: SparkSession, store: str) -> int:
    """Delete bucket folders that the newest run doesn't refer to, when no reader uses an older run; how many."""
    newest = latest_run(spark, store)
    places = Places.of(spark, store, newest)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in files.globStatus(path(f"{store}/run=*/*/{BUCKET}=*")):
        at = status.getPath()
        name, run = at.getParent().getName(), int(at.getParent().getParent().getName().split("=")[1])
        if run <= (newest or 0) and places.runs.get(name, {}).get(int(at.getName().split("=")[1])) != run:
            files.delete(at, True)
            gone += 1
    return gone
