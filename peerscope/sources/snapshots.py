"""Versioned parquet tables: a new version is complete before it is read."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Snapshots:
    """Tables below ``root``; each write adds ``<table>/version=<n>``.

    A version counts once Spark has put its ``_SUCCESS`` file, so a job that
    dies while writing leaves the previous version in place, and a table may be
    rewritten from its own rows. A writer claims its number before it writes, so
    two writers never share a version; the one that claimed last is read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str):
        """A path below the root, and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, name: str, complete: bool) -> list[int]:
        path, files = self._path(name)
        if not files.exists(path):
            return []
        below = [status.getPath() for status in files.listStatus(path)]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("=")[1]) for p in below if not complete or files.exists(done(p, "_SUCCESS")))

    def versions(self, table: str) -> list[int]:
        return self._numbers(table, complete=True)

    def claim(self, table: str) -> int:
        """The next version's number, for the caller alone: an empty file that is created without overwriting.

        Two writers at once are told apart by the store, which HDFS does in one
        step. A claim of a writer that died stays, and its number is never used again.
        """
        version = max(self.versions(table) + self._numbers(f"_claims/{table}", complete=False), default=0) + 1
        while True:
            path, files = self._path(f"_claims/{table}/version={version}")
            try:
                files.create(path, False).close()
                return version
            except Py4JJavaError:
                if not files.exists(path):
                    raise
                version += 1

    def write(self, table: str, df: DataFrame, sort_by: str | None = None) -> int:
        """Write the next version; ``sort_by`` clusters it for lookups."""
        version = self.claim(table)
        if sort_by:
            df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/version={version}")
        return version

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        versions = self.versions(table)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/version={versions[-1]}")

    def retain(self, table: str, keep: int = 2) -> list[int]:
        """Delete all complete versions but the newest ``keep``, which readers may still hold; returns the deleted."""
        if keep < 1:
            raise ValueError("keep at least the newest version")
        old = self.versions(table)[:-keep]
        for version in old:
            path, files = self._path(f"{table}/version={version}")
            files.delete(path, True)
        return old

    def wipe(self, tables: dict[str, T.StructType], confirm: str) -> dict:
        """Delete every version of every table; ``confirm`` must repeat the root.

        Returns the number of rows dropped and whether there were none.
        """
        if confirm.rstrip("/") != self.root:
            raise ValueError("confirm must name the root to wipe")
        dropped = sum(self.read(name, schema).count() for name, schema in tables.items())
        for name in tables:
            path, files = self._path(name)
            files.delete(path, True)
        return {"dropped": dropped, "empty": dropped == 0}
