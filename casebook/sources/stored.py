"""Tables that are kept for lookups: bucketed and sorted by what they are looked up by, and appended batch by batch.

A table is a folder; its rows lie in one partition a batch and, in it, in a fixed number of buckets by the hash of one column. A filter on that column reads one bucket of each
batch (`SelectedBucketsCount` in the plan), and its statistics, as files are sorted, leave only the row groups that can hold the value. A join or a grouping by the column needs
no shuffle of the table. Writing a batch again replaces it, so a stream's batch that is run twice counts once.

Batches make small files; `compact` writes several as one. The catalog of a session only points to the folder, so another session opens it by path.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.errors import ValidationError

MAX_LITERALS = 10_000  # values that are looked up by a filter; more are joined


@dataclass(frozen=True)
class StoredTable:
    """``columns`` (DDL) at ``path``, in ``buckets`` by ``key``, sorted by ``key`` and ``order`` within files."""

    path: str
    columns: str
    key: str
    order: tuple[str, ...] = ()
    buckets: int = 64
    spread: str = ""  # SQL: a small whole number that deals a bucket to several tasks, for tables in which one key may have very many rows

    @property
    def name(self) -> str:
        return f"casebook_{hashlib.sha256(self.path.encode()).hexdigest()[:32]}"

    def _opened(self, spark: SparkSession) -> None:
        if spark.catalog.tableExists(self.name):
            return
        spark.sql(
            f"create table if not exists {self.name} ({self.columns}, batch long) using parquet options ('compression' 'zstd') partitioned by (batch) "
            f"clustered by ({self.key}) sorted by ({', '.join((self.key, *self.order))}) into {self.buckets} buckets location '{self.path}'"
        )
        self.refresh(spark)

    def refresh(self, spark: SparkSession) -> None:
        """Sees the batches that other applications have written since this one opened the table."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.sql(f"msck repair table {self.name}")

    def read(self, spark: SparkSession) -> DataFrame:
        """All batches; the columns and ``batch``."""
        self._opened(spark)
        return spark.table(self.name)

    def write(self, df: DataFrame, batch: int) -> None:
        """Makes ``df`` the rows of a batch, whatever the batch held before. Rows are dealt by bucket (and ``spread``), so a task writes few files."""
        spark = df.sparkSession
        self._opened(spark)
        view = f"{self.name}_{uuid.uuid4().hex}"
        names = [f.name for f in spark.table(self.name).schema if f.name != "batch"]
        bucket = F.pmod(F.hash(self.key), F.lit(self.buckets))
        dealt = df.select(*names).repartition(bucket, *([F.expr(self.spread)] if self.spread else []))
        dealt.createOrReplaceTempView(view)
        try:
            spark.sql(f"insert overwrite table {self.name} partition (batch = {int(batch)}) select {', '.join(names)} from {view}")
        finally:
            spark.catalog.dropTempView(view)

    def batches(self, spark: SparkSession) -> list[int]:
        return sorted(r["batch"] for r in self.read(spark).select("batch").distinct().collect())

    def of(self, spark: SparkSession, values: list) -> DataFrame:
        """The rows of some values of the key: only their buckets are read."""
        if len(values) > MAX_LITERALS:
            raise ValidationError(f"at most {MAX_LITERALS} values can be looked up by a filter")
        return self.read(spark).where(F.col(self.key).isin(values))

    def compact(self, spark: SparkSession, path: str, upto: int, merged: DataFrame | None = None) -> StoredTable:
        """A new table at ``path``: batches up to ``upto`` as one (``merged``: their rows, if they shall not stay as they are), later ones as they are.

        The old folder stays for those who still read it.
        """
        new = replace(self, path=path)
        rows = self.read(spark)
        new.write(rows.where(F.col("batch") <= upto).drop("batch") if merged is None else merged, upto)
        for later in (b for b in self.batches(spark) if b > upto):
            new.write(rows.where(F.col("batch") == later).drop("batch"), later)
        return new


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a file or folder: names, sizes and times of what it holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    said = sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in found)
    return hashlib.sha256("\n".join((path, *said)).encode()).hexdigest()[:32]
