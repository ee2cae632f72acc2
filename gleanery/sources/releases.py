"""Several tables that change together: a release is a manifest of table folders, and readers see the last whole one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Releases:
    """Tables under ``path``. Each release writes the tables it changes to new folders and then its manifest, in one commit.

    A job that stops before the manifest is there changes nothing for readers, and its folders are written over by the
    next attempt. One job writes at a time; files of earlier releases stay for readers that began before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _done(self, n: int) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{n:09d}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def last(self) -> int:
        """The number of the last release; -1 before the first one."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [int(s.getPath().getName()) for s in files.listStatus(root)] if files.exists(root) else []
        return max((n for n in found if self._done(n)), default=-1)

    def manifest(self, n: int) -> dict[str, int]:
        """The release that wrote each table of release ``n`` last."""
        return {r.table_name: r.release for r in self.spark.read.json(f"{self.path}/manifests/{n:09d}", schema="table_name string, release long").collect()} if n >= 0 else {}

    def read(self, table: str, n: int | None = None) -> DataFrame:
        """A table as of release ``n``, the last one by default."""
        n = self.last() if n is None else n
        return self.spark.read.parquet(f"{self.path}/{table}/{self.manifest(n)[table]:09d}")

    def write(self, tables: dict[str, DataFrame], before_commit: Callable[[int], None] | None = None) -> int:
        """Writes the next release; tables that aren't given stay as they are. ``before_commit`` may look at the written folders and stop it all by an error."""
        known = self.last()
        n = known + 1
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{table}/{n:09d}")
        if before_commit is not None:
            before_commit(n)
        rows = sorted((self.manifest(known) | dict.fromkeys(tables, n)).items())
        self.spark.createDataFrame(rows, "table_name string, release long").select("table_name", F.col("release")).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifests/{n:09d}")
        return n
