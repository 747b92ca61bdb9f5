"""Files as a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.text import extension

# Picture extensions of the corpus scan.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp")


def _listing(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    plain = F.regexp_replace("path", "^file:/*", "/")
    return files.select(
        plain.alias("path"),
        F.col("length").alias("size"),
        F.unix_micros("modificationTime").alias("mtime"),
        "content",
    )


def scan_corpus(spark: SparkSession, root: str, exts: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """``path, size, mtime, content`` of every file below ``root`` with one of the extensions.

    Selecting without ``content`` lists only: the bytes are then not read. Names starting with ``.`` or ``_`` are
    never listed by Spark.
    """
    return _listing(spark, [root]).filter(extension(F.col("path")).isin(*exts))


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Files of any type below several roots, in path order."""
    visible = ~F.col("path").rlike(r"(^|/)\.")
    return _listing(spark, roots).filter(visible).orderBy("path")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pictures below ``root`` (undecodable ones with width -1)."""
    return spark.read.format("image").option("recursiveFileLookup", True).load(root)
