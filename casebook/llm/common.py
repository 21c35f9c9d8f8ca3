"""What several of the operators share: tables, identities and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, so that no other name can clash with its own."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in more))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where none is set and executors run in this process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not context.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="casebook-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes what `written` has written in this session; for when results are stored elsewhere and nothing derived from it is read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    while _WRITTEN:
        at = path(_WRITTEN.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    Parquet is several times smaller than ``checkpoint()`` of the same rows, and
    like it survives the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/casebook-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z only; ``lower`` would also change other scripts."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
