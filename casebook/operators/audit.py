"""The audit trail: append-only rows, newest first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "occurred_at timestamp_ntz, action string, actor string, resource_type string, resource_id string, detail string"


def append(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, AUDIT).withColumn("occurred_date", F.to_date("occurred_at")).write.mode("append").partitionBy("occurred_date").parquet(path)


def query(trail: DataFrame, action: str | None = None, actor: str | None = None, start: datetime | None = None, end: datetime | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    from casebook.operators.timeline import in_window

    out = in_window(trail, start, end)
    for c, v in (("action", action), ("actor", actor)):
        out = out if v is None else out.where(F.col(c) == v)
    return out.orderBy(F.desc("occurred_at"), "action", "resource_id").offset(offset).limit(min(limit, 1000))
