"""Small tables of the newest state of each key, replaced as a whole and kept in versions.

A version is a folder that counts once its write is complete (Spark's ``_SUCCESS``). Readers take the newest complete one, so a run
that dies while it writes leaves the one before; that one is kept until the run after next for readers that are still at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import remove


class VersionedTable:
    """A table that is replaced and never appended to. One job replaces it at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> list[int]:
        """Complete versions, oldest first. Lists a folder of a few entries."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(place):
            return []
        found = [entry.getPath() for entry in store.listStatus(place)]
        done = [p for p in found if store.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v")) for p in done)

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version:012d}"

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        """Rows of the newest version; none before the first."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(versions[-1]))

    def replace(self, rows: DataFrame) -> None:
        """``rows`` may read the version they replace."""
        versions = self._versions()
        new = versions[-1] + 1 if versions else 0
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._folder(new))
        for old in versions[:-1]:
            remove(self.spark, self._folder(old))
