"""Session defaults shared by tests, the bench and applications."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cairnfield", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on; on a cluster leave ``master`` to spark-submit.

    The package goes to the executors with it. ``spark.checkpoint.dir`` names the folder for written steps.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture costs several round trips per column expression when plans are built.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("CAIRNFIELD_DRIVER_MEMORY", "8g"))
        )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset in local mode, as in tests, a new folder that is then set in the session.

    On a cluster an unset folder is an error: executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written as parquet in the shared folder and read back: what follows starts from there."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python tasks can import it anywhere."""
    if spark.conf.get("spark.cairnfield.shipped", "") == spark.sparkContext.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "cairnfield"), "zip", os.path.dirname(here), os.path.basename(here)
    )
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.cairnfield.shipped", spark.sparkContext.applicationId)
