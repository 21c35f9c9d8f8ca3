"""From parsed rows to events: ids, arrival times, sources, checks; and the nested view of a flat event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.errors import ValidationError
from casebook.functions.hashing import sha256
from casebook.functions.text import canonical_ip, lexemes
from casebook.operators.timeline import SEARCHED
from casebook.schema import EVENT_COLUMNS, FUTURE_SECONDS

NESTED = {
    "actor": {"id": "actor_id", "name": "actor_name", "actor_type": "actor_type"},
    "subject": {"id": "subject_id", "name": "subject_name", "subject_type": "subject_type"},
    "object": {"id": "object_id", "name": "object_name", "object_type": "object_type"},
    "network": {c: c for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")},
    "device": {c: c for c in ("device_id", "device_name", "device_type", "hostname")},
    "source": {c: c for c in ("source_id", "source_type", "source_name")},
}


def in_future(now: Column) -> Column:
    return F.col("occurred_at") > now + F.expr(f"interval {FUTURE_SECONDS} seconds")


def normalized(parsed: DataFrame, now: Column, source_id: str = "api", source_type: str = "direct", source_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejected): parsed rows with ids and source; rows from the future are rejected.

    An id follows from the raw event and the row's place in it, so ingesting again gives the same ids.
    Addresses are canonical; rows with an address that is none are rejected as well.
    """
    named = parsed.withColumns(
        {
            "source_id": F.coalesce(*([F.col("source_id")] if "source_id" in parsed.columns else []), F.lit(source_id)),
            "source_type": F.coalesce(*([F.col("source_type")] if "source_type" in parsed.columns else []), F.lit(source_type)),
            "source_name": F.lit(source_name).cast("string"), "received_at": now.cast("timestamp_ntz"),
            "event_id": F.abs(F.xxhash64("raw_event_id", "ordinal")),
            "_src": canonical_ip("src_ip"), "_dst": canonical_ip("dst_ip"),
        }
    )
    bad_ip = (F.col("src_ip").isNotNull() & F.col("_src").isNull()) | (F.col("dst_ip").isNotNull() & F.col("_dst").isNull())
    why = F.when(in_future(now), "occurred_at is in the future").when(bad_ip, "not an address").otherwise(F.lit(None))
    judged = named.withColumn("rejected_because", why)
    good = judged.where("rejected_because is null").withColumns({"src_ip": F.col("_src"), "dst_ip": F.col("_dst")})
    columns = [F.col(c) if c in judged.columns else F.lit(None).cast(kind).alias(c) for c, kind in EVENT_COLUMNS.items()]
    return good.select(*columns), judged.where("rejected_because is not null").drop("_src", "_dst")


def require_none(rejected: DataFrame) -> None:
    """Strict ingest: one bad row fails the batch."""
    row = rejected.select("rejected_because").first()
    if row is not None:
        raise ValidationError(row[0])


def nested(events: DataFrame) -> DataFrame:
    """The flat columns of each part as a struct, null if all of them are."""
    flat = {c for part in NESTED.values() for c in part.values()}
    parts = []
    for name, fields in NESTED.items():
        there = {k: c for k, c in fields.items() if c in events.columns}
        if there:
            some = F.greatest(*(F.col(c).isNotNull() for c in there.values()), F.lit(False))
            parts.append(F.when(some, F.struct(*(F.col(c).alias(k) for k, c in there.items()))).alias(name))
    return events.select(*(c for c in events.columns if c not in flat), *parts)


def stored(events: DataFrame) -> DataFrame:
    """What is written: with the lexemes that search reads, and the date that partitions the table."""
    return events.withColumns({"lexemes": lexemes(*(c for c in SEARCHED if c in events.columns)), "occurred_date": F.to_date("occurred_at")})


def raw_view(events: DataFrame, raw: DataFrame) -> DataFrame:
    """Each event's raw payload without its content, and whether the content still has its hash."""
    kept = raw.select("raw_event_id", "content_hash", "content_type", "byte_size", (sha256(F.col("content")) == F.col("content_hash")).alias("hash_verified"))
    return events.select("event_id", "raw_event_id").join(kept, "raw_event_id")
