"""Entities and relationships: derived from events by aggregation, not by upserts.

Observations come from an event's actor (user), addresses (ip), device and host; of two
observations of one entity in an event (src_ip = dst_ip) the first role stays. ``ingest_order`` (the event
id) stands for arrival order where the latest value wins.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.errors import ValidationError
from casebook.functions.text import present
from casebook.schema import ENTITY_TYPES

CARRIED = ("event_id", "occurred_at")


def observations(events: DataFrame) -> DataFrame:
    """event_id, occurred_at, entity_type, identifier, display_name, role."""
    none = F.lit(None).cast("string")
    device_name = present("device_name") if "device_name" in events.columns else none
    # only the two addresses can name one entity twice
    other_ip = F.when(~present("dst_ip").eqNullSafe(present("src_ip")), present("dst_ip"))
    parts = [
        ("user", present("actor_id"), present("actor_name"), "actor"), ("ip", present("src_ip"), none, "src_ip"), ("ip", other_ip, none, "dst_ip"),
        ("device", present("device_id"), device_name, "device"), ("host", present("hostname"), none, "host"),
    ]
    made = F.array(*(F.struct(F.lit(t).alias("entity_type"), i.alias("identifier"), n.alias("display_name"), F.lit(r).alias("role")) for t, i, n, r in parts))
    return events.select(*CARRIED, F.explode(made).alias("x")).select(*CARRIED, "x.*").where("identifier is not null")


def relation_observations(events: DataFrame) -> DataFrame:
    """event_id, occurred_at, source_type, source, relationship, target_type, target; both ends must be there."""
    parts = [
        ("user", "actor_id", "from_ip", "ip", "src_ip"), ("user", "actor_id", "used_device", "device", "device_id"),
        ("user", "actor_id", "hosted_on", "host", "hostname"), ("device", "device_id", "from_ip", "ip", "src_ip"),
    ]
    made = F.array(*(F.struct(F.lit(a).alias("source_type"), present(s).alias("source"), F.lit(r).alias("relationship"), F.lit(b).alias("target_type"), present(t).alias("target")) for a, s, r, b, t in parts))
    return events.select(*CARRIED, F.explode(made).alias("x")).select(*CARRIED, "x.*").where("source is not null and target is not null")


def entities(seen: DataFrame, first_by_ingest: bool = False) -> DataFrame:
    """One row an entity. ``first_by_ingest``: first_seen is the time of the event that arrived first, not the earliest."""
    first = F.min_by("occurred_at", "event_id") if first_by_ingest else F.min("occurred_at")
    return seen.groupBy("entity_type", "identifier").agg(
        F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.col("event_id"))).alias("display_name"),
        first.alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.count("*").alias("event_count"),
    )


def relationships(seen: DataFrame) -> DataFrame:
    return seen.groupBy("source_type", "source", "relationship", "target_type", "target").agg(
        F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.count("*").alias("event_count"), F.max("event_id").alias("sample_event_id")
    )


def partial_entities(seen: DataFrame) -> DataFrame:
    """What `entities` needs of a part of the events, in a form that `merged_entities` can add up with other parts."""
    named = F.when(F.col("display_name").isNotNull(), F.struct("event_id", "display_name"))
    return seen.groupBy("entity_type", "identifier").agg(
        F.max(named).alias("latest"), F.min(F.struct("event_id", "occurred_at")).alias("arrived"),
        F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.count("*").alias("event_count"),
    )


def merged_entities(parts: DataFrame, first_by_ingest: bool = False) -> DataFrame:
    """`entities` of all events together; parts may come in any order."""
    first = F.min("arrived")["occurred_at"] if first_by_ingest else F.min("first_seen")
    return parts.groupBy("entity_type", "identifier").agg(
        F.max("latest")["display_name"].alias("display_name"), first.alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count")
    )


def partial_adjacency(seen: DataFrame) -> DataFrame:
    """`relationships` of a part of the events, once from each end: end_type, end, other_type, other, relationship, outgoing and the aggregates."""
    found = relationships(seen)
    sides = [("source", "target", True), ("target", "source", False)]
    both = F.array(*(F.struct(F.col(f"{a}_type").alias("end_type"), F.col(a).alias("end"), F.col(f"{b}_type").alias("other_type"), F.col(b).alias("other"), F.lit(out).alias("outgoing")) for a, b, out in sides))
    rows = found.select(F.explode(both).alias("x"), "relationship", "first_seen", "last_seen", "event_count", "sample_event_id")
    return rows.select("x.*", "relationship", "first_seen", "last_seen", "event_count", "sample_event_id")


def merged_relationships(parts: DataFrame) -> DataFrame:
    """`relationships` from adjacency rows of one direction or both; a relationship that is there from both ends counts once."""
    out = F.col("outgoing")
    way = lambda a, b: F.when(out, F.col(a)).otherwise(F.col(b))
    named = parts.select(
        way("end_type", "other_type").alias("source_type"), way("end", "other").alias("source"), "relationship", way("other_type", "end_type").alias("target_type"), way("other", "end").alias("target"),
        "outgoing", "first_seen", "last_seen", "event_count", "sample_event_id",
    )
    counted = lambda side: F.sum(F.when(side, F.col("event_count")))
    return named.groupBy("source_type", "source", "relationship", "target_type", "target").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.coalesce(counted(out), counted(~out)).alias("event_count"), F.max("sample_event_id").alias("sample_event_id")
    )


def _newest(df: DataFrame, limit: int | None, *ties: str) -> DataFrame:
    return df if limit is None else df.orderBy(F.desc("last_seen"), *ties).limit(limit)


def listed(found: DataFrame, entity_type: str | None = None, limit: int | None = 50) -> DataFrame:
    if entity_type is not None and entity_type not in ENTITY_TYPES:
        raise ValidationError(f"unknown entity type {entity_type!r}")
    return _newest(found if entity_type is None else found.where(F.col("entity_type") == entity_type), limit, "entity_type", "identifier")


def searched(found: DataFrame, text: str, entity_type: str | None = None, limit: int | None = 50) -> DataFrame:
    """Entities whose identifier contains the text, in any case."""
    return listed(found.where(F.contains(F.lower("identifier"), F.lit(text.lower()))), entity_type, limit)


def one(found: DataFrame, entity_type: str, identifier: str) -> DataFrame:
    return found.where((F.col("entity_type") == entity_type) & (F.col("identifier") == identifier))


def relationships_of(edges: DataFrame, entity_type: str, identifier: str, limit: int | None = 500) -> DataFrame:
    end = lambda side: (F.col(f"{side}_type") == entity_type) & (F.col(side) == identifier)
    return _newest(edges.where(end("source") | end("target")), limit, "source_type", "source", "relationship", "target_type", "target")


def links(seen: DataFrame, entity_type: str, identifier: str, role: str | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    from casebook.operators.timeline import in_window

    out = in_window(one(seen, entity_type, identifier), start, end)
    return out if role is None else out.where(F.col("role") == role)


def timeline(seen: DataFrame, events: DataFrame, entity_type: str, identifier: str, start: datetime | None = None, end: datetime | None = None, limit: int | None = 100) -> DataFrame:
    """Events of an entity, newest first."""
    ids = links(seen, entity_type, identifier, None, start, end).select("event_id").distinct()
    out = events.join(ids, "event_id")
    return out if limit is None else out.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(limit)
