"""Tables that operators write for themselves, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from casebook.errors import ValidationError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where it is unset and executors run in this process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not context.master.startswith("local"):
            raise ValidationError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="casebook-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes what `cut` has written in this session; for when results are stored elsewhere and nothing derived from it is read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    while _WRITTEN:
        at = path(_WRITTEN.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/casebook-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
