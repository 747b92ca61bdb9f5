"""Written steps: parquet in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from cairnfield.session import shared_folder


def collect_garbage(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs once their plans are collected in the driver's JVM."""
    gc.collect()
    spark._jvm.System.gc()


def refuse_clashes(*names: str) -> None:
    """A result whose columns would share a name is an error."""
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns clash in the result: {twice}")


class Step:
    """A written DataFrame: ``df`` reads it back, ``drop`` removes its files once nothing reads them any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        collect_garbage(self.spark)
        df.write.parquet(self.path)
        collect_garbage(self.spark)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
