"""A table as numbered folders of Parquet files.

A change writes a whole new version; readers take the greatest version that
has Spark's success marker, so a failed write is never seen.  One writer at a
time.  Old versions beyond a number are removed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, keep: int = 20, partition_by: str | None = None):
        self.spark, self.root, self.keep, self.partition_by = spark, root.rstrip("/"), keep, partition_by

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Complete versions, the oldest first."""
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return []
        found = [int(m[1]) for s in fs.listStatus(root) if (m := re.match(r"v=(\d+)$", s.getPath().getName()))]
        return sorted(v for v in found if fs.exists(self._fs(f"{self.root}/v={v}/_SUCCESS")[1]))

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None) -> DataFrame:
        chosen = version if version is not None else self.versions()[-1]
        return self.spark.read.parquet(f"{self.root}/v={chosen}")

    def write(self, rows: DataFrame) -> int:
        """Writes rows as the next version and returns its number."""
        done = self.versions()
        version = (done[-1] if done else 0) + 1
        fs, path = self._fs(f"{self.root}/v={version}")
        fs.delete(path, True)  # what a failed write has left
        writer = rows.write.mode("error")
        (writer.partitionBy(self.partition_by) if self.partition_by else writer).parquet(f"{self.root}/v={version}")
        for old in self.versions()[: -self.keep]:
            fs.delete(self._fs(f"{self.root}/v={old}")[1], True)
        return version

    def restore(self, version: int) -> int:
        """Makes an older version the current one again, as a new version."""
        return self.write(self.read(version))
