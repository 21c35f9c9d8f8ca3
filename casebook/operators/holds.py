"""Legal holds: which events must be kept. Materialising a hold adds the events it lacks; adding twice adds nothing."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.errors import NotFoundError, ValidationError
from casebook.operators.entities import links
from casebook.operators.timeline import Filters, filtered, in_window
from casebook.plans.state import StateTable
from casebook.schema import HOLD_TYPES

HOLD = "hold_id string, name string, hold_type string, criteria string, status string, created_by string, created_at timestamp_ntz, expires_at timestamp_ntz, released_at timestamp_ntz"
CRITERIA_BYTES = 10_240


class Holds:
    def __init__(self, spark: SparkSession, path: str):
        self.holds = StateTable(spark, f"{path}/holds", HOLD)

    def create(self, name: str, hold_type: str, criteria: dict, created_by: str, at: datetime, expires_at: datetime | None = None) -> str:
        if hold_type not in HOLD_TYPES:
            raise ValidationError(f"unknown hold type {hold_type!r}")
        text = json.dumps(criteria, sort_keys=True)
        if len(text.encode()) > CRITERIA_BYTES or not name.strip():
            raise ValidationError(f"a hold needs a name and criteria of at most {CRITERIA_BYTES} bytes")
        hold_id = str(uuid.uuid4())
        self.holds.append([(hold_id, name, hold_type, text, "active", created_by, at, expires_at, None)])
        return hold_id

    def get(self, hold_id: str) -> DataFrame:
        found = self.holds.read().where(F.col("hold_id") == hold_id)
        if found.first() is None:
            raise NotFoundError(f"hold {hold_id} not found")
        return found

    def listed(self, status: str | None = None, limit: int = 100) -> DataFrame:
        found = self.holds.read() if status is None else self.holds.read().where(F.col("status") == status)
        return found.orderBy(F.desc("created_at"), "hold_id").limit(limit)

    def release(self, hold_id: str, at: datetime) -> None:
        if self.get(hold_id).first()["status"] != "active":
            raise ValidationError("only an active hold can be released")
        own = F.col("hold_id") == hold_id
        new = {"status": F.when(own, "released").otherwise(F.col("status")), "released_at": F.when(own, F.lit(at)).otherwise(F.col("released_at"))}
        self.holds.write(self.holds.read().withColumns(new))


def of_time_range(events: DataFrame, start: datetime, end: datetime, limit: int | None = None) -> DataFrame:
    """event_id of all events of [start, end]; with a ``limit`` only the earliest, for a page of them."""
    found = in_window(events, start, end, closed=True)
    return (found if limit is None else found.orderBy("occurred_at", "event_id").limit(limit)).select("event_id")


def of_case(case_events: DataFrame, events: DataFrame) -> DataFrame:
    """Attached events that exist; others are left out."""
    return case_events.select("event_id").distinct().join(events.select("event_id"), "event_id", "left_semi")


def of_entity(observed: DataFrame, entity_type: str, identifier: str) -> DataFrame:
    return links(observed, entity_type, identifier).select("event_id").distinct()


def of_query(events: DataFrame, by: Filters) -> DataFrame:
    return filtered(events, by).select("event_id")


def missing(hold_id: str, wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(hold_id, event_id) rows to append."""
    return wanted.select(F.lit(hold_id).alias("hold_id"), "event_id").join(held, ["hold_id", "event_id"], "left_anti")


def held_events(events: DataFrame, hold_events: DataFrame, holds: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Events in an active hold. Expiry is looked at only if ``as_of`` is given."""
    active = holds.where("status = 'active'")
    if as_of is not None:
        active = active.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of)))
    return events.join(hold_events.join(active.select("hold_id"), "hold_id", "left_semi"), "event_id", "left_semi")


def counts(hold_events: DataFrame) -> DataFrame:
    return hold_events.groupBy("hold_id").agg(F.count("*").alias("n_events"))
