"""Small mutable tables (cases, attachments, holds, audit): immutable snapshots and a pointer to the current one.

Parquet has no MERGE. A change writes a new version beside the old and then moves the pointer,
so readers see one version or the other. Rows are few (investigations, not events); event-sized
results such as the events of a hold are appended instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StateTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self) -> tuple[object, Callable[[str], object]]:
        jvm = self.spark._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The newest version that was written whole; 0 if there is none."""
        fs, at = self._fs()
        if not fs.exists(at(self.path)):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at(self.path))]
        done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(at(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> DataFrame:
        now = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={now}") if now else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> DataFrame:
        columns = self.spark.createDataFrame([], self.schema).schema
        df.select(*(F.col(f.name).cast(f.dataType) for f in columns)).coalesce(1).write.parquet(f"{self.path}/v={self.version() + 1}")
        return self.read()

    def append(self, rows: list[tuple]) -> DataFrame:
        return self.write(self.read().union(self.spark.createDataFrame(rows, self.schema)))
