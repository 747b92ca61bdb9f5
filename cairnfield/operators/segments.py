"""A text index that is refreshed by appending: segments of postings, and keys deleted since.

Every refresh writes one segment with what changed and the keys that older segments no longer answer for. Readers take
the segments of the newest list and leave deleted keys out. Segments of like size are merged, so that a posting is
rewritten a number of times that grows with the logarithm of the index.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators.skew import salted_join
from cairnfield.operators.textsearch import TextIndex, hot_keys

MERGED_AT_ONCE = 4  # segments of one size class before they are merged
ROW_GROUP = 8 << 20
PARTS = ("postings", "lengths", "deleted")


class SegmentedIndex:
    """Folders ``segment-<n>`` with postings, lengths and deleted keys, and numbered lists of the live ones.

    One writer at a time. A list is written after its segments, so a reader or a failed writer never sees half a refresh.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._files = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> list[int]:
        if not self._files.exists(self._at("lists")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._at("lists"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def live(self) -> list[dict]:
        """Segments from old to new: ``number``, ``rows`` of its postings."""
        versions = self._versions()
        if not versions:
            return []
        source = self._files.open(self._at(f"lists/{versions[-1]:09d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def _publish(self, segments: list[dict]) -> None:
        version = (self._versions() or [0])[-1] + 1
        out = self._files.create(self._at(f"lists/.{version:09d}"), True)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        if not self._files.rename(self._at(f"lists/.{version:09d}"), self._at(f"lists/{version:09d}.json")):
            raise RuntimeError(f"another writer published list {version} of {self.path}")

    def _write(self, number: int, postings: DataFrame, lengths: DataFrame, deleted: DataFrame) -> dict:
        folder = f"{self.path}/segment-{number}"
        # Every task sorts what it has: small row groups hold a range of terms each, and no posting is shuffled.
        postings.sortWithinPartitions("term", self.key).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/postings")
        lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
        deleted.select(self.key).distinct().write.mode("overwrite").parquet(f"{folder}/deleted")
        return {"number": number, "rows": self.spark.read.parquet(f"{folder}/postings").count()}

    def _read(self, part: str, segments: list[dict]) -> DataFrame:
        every = [self.spark.read.parquet(f"{self.path}/segment-{s['number']}/{part}").withColumn("_segment", F.lit(s["number"])) for s in segments]
        return reduce(DataFrame.unionByName, every)

    def _without_deleted(self, part: str, segments: list[dict], newer: list[dict], spread: str | None) -> DataFrame:
        """Rows of the segments whose key no later one of them, nor one of ``newer``, deletes."""
        gone = self._read("deleted", [*segments, *newer]).groupBy(self.key).agg(F.max("_segment").alias("_gone"))
        gone = gone.hint("shuffle_hash")  # a row per key, beside many postings
        rows = self._read(part, segments)
        hot = hot_keys(self._read("lengths", segments), self.key) if spread else None
        kept = salted_join(rows, gone, [self.key], "left", spread=[spread], hot=hot) if spread else rows.join(gone, self.key, "left")
        return kept.filter(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_segment"))).drop("_gone", "_segment")

    def read(self) -> TextIndex:
        """The index as the newest list has it."""
        segments = self.live()
        if not segments:
            raise ValueError(f"no index at {self.path}")
        return TextIndex(self._without_deleted("postings", segments, [], "term"), self._without_deleted("lengths", segments, [], None), self.key)

    def refresh(self, changed: TextIndex, removed: DataFrame | None = None) -> None:
        """Add or replace the keys of ``changed`` and take out those of ``removed``; writes that much, and merges seldom."""
        segments = self.live()
        number = max((s["number"] for s in segments), default=0) + 1
        # The first segment has nothing older to take out.
        stale = changed.lengths.select(self.key) if segments else changed.lengths.select(self.key).limit(0)
        stale = stale if removed is None or not segments else stale.unionByName(removed.select(self.key))
        self._publish([*segments, self._write(number, changed.postings, changed.lengths, stale)])
        self._merge()

    def _merge(self) -> None:
        """Put the newest segments together while ``MERGED_AT_ONCE`` of them are of one size class."""
        while True:
            segments = self.live()
            last = segments[-MERGED_AT_ONCE:]
            small = max(s["rows"] for s in last) <= MERGED_AT_ONCE * (min(s["rows"] for s in last) + 1)
            if len(last) < MERGED_AT_ONCE or not small:
                return
            older, number = segments[:-MERGED_AT_ONCE], segments[-1]["number"] + 1
            deleted = self._read("deleted", last)
            made = self._write(
                number, self._without_deleted("postings", last, [], "term"), self._without_deleted("lengths", last, [], None), deleted
            )
            self._publish([*older, made])

    def clean(self) -> None:
        """Delete segments and lists that the newest list doesn't name; when no reader uses an older one."""
        keep = {f"segment-{s['number']}" for s in self.live()}
        for status in self._files.listStatus(self._at(".")):
            name = status.getPath().getName()
            if name.startswith("segment-") and name not in keep:
                self._files.delete(status.getPath(), True)
        for version in self._versions()[:-1]:
            self._files.delete(self._at(f"lists/{version:09d}.json"), False)
