"""Investigation cases: create, list, patch, attach, detach, pin and annotate."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.errors import NotFoundError, ValidationError
from casebook.plans.state import StateTable
from casebook.schema import CASE_STATUSES

CASE = "case_id string, name string, description string, status string, created_by string, created_at timestamp_ntz, updated_at timestamp_ntz"
ATTACHED = "case_id string, event_id long, pinned boolean, annotation string, added_by string, added_at timestamp_ntz"


def _sized(name: str, value: str, most: int, least: int = 0) -> str:
    if not least <= len(value.strip().encode()) or len(value.encode()) > most:
        raise ValidationError(f"{name} must have {least} to {most} bytes")
    return value


class Cases:
    def __init__(self, spark: SparkSession, path: str):
        self.cases, self.attached = StateTable(spark, f"{path}/cases", CASE), StateTable(spark, f"{path}/case_events", ATTACHED)

    def create(self, name: str, created_by: str, at: datetime, description: str = "") -> str:
        case_id = str(uuid.uuid4())
        row = (case_id, _sized("name", name, 200, 1), _sized("description", description, 5000), "open", _sized("created_by", created_by, 200, 1), at, at)
        self.cases.append([row])
        return case_id

    def get(self, case_id: str) -> DataFrame:
        found = self.cases.read().where(F.col("case_id") == case_id)
        if found.first() is None:
            raise NotFoundError(f"case {case_id} not found")
        return found

    def listed(self, status: str | None = None, limit: int = 100) -> DataFrame:
        if status is not None and status not in CASE_STATUSES:
            raise ValidationError(f"unknown status {status!r}")
        found = self.cases.read() if status is None else self.cases.read().where(F.col("status") == status)
        return found.orderBy(F.desc("updated_at"), "case_id").limit(limit)

    def patch(self, case_id: str, at: datetime, name: str | None = None, description: str | None = None, status: str | None = None) -> DataFrame:
        new = {k: v for k, v in (("name", name), ("description", description), ("status", status)) if v is not None}
        if not new:
            raise ValidationError("nothing to change")
        if status is not None and status not in CASE_STATUSES:
            raise ValidationError(f"unknown status {status!r}")
        self.get(case_id)
        own = F.col("case_id") == case_id
        changed = {k: F.when(own, F.lit(v)).otherwise(F.col(k)) for k, v in new.items()}
        self.cases.write(self.cases.read().withColumns(changed | {"updated_at": F.when(own, F.lit(at)).otherwise(F.col("updated_at"))}))
        return self.get(case_id)

    def events(self, case_id: str, limit: int | None = 100) -> DataFrame:
        found = self.attached.read().where(F.col("case_id") == case_id)
        return found if limit is None else found.orderBy("added_at", "event_id").limit(limit)

    def attach(self, case_id: str, event_id: int, added_by: str, at: datetime, pinned: bool = False, annotation: str = "") -> None:
        self.get(case_id)
        if self.events(case_id, None).where(F.col("event_id") == event_id).first() is not None:
            raise ValidationError(f"event {event_id} is attached already")
        self.attached.append([(case_id, event_id, pinned, annotation, added_by, at)])

    def attach_all(self, rows: DataFrame) -> None:
        """Attaches many events in one write (the columns of `ATTACHED`); those that are attached already stay as they are."""
        now = self.attached.read()
        self.attached.write(now.unionByName(rows.join(now.select("case_id", "event_id"), ["case_id", "event_id"], "left_anti").select(*now.columns)))

    def _own(self, case_id: str, event_id: int):
        own = (F.col("case_id") == case_id) & (F.col("event_id") == event_id)
        if self.attached.read().where(own).first() is None:
            raise NotFoundError(f"event {event_id} is not attached")
        return own

    def detach(self, case_id: str, event_id: int) -> None:
        self.attached.write(self.attached.read().where(~self._own(case_id, event_id)))

    def mark(self, case_id: str, event_id: int, pinned: bool | None = None, annotation: str | None = None) -> None:
        new = {k: v for k, v in (("pinned", pinned), ("annotation", annotation)) if v is not None}
        if not new:
            raise ValidationError("nothing to change")
        own = self._own(case_id, event_id)
        self.attached.write(self.attached.read().withColumns({k: F.when(own, F.lit(v)).otherwise(F.col(k)) for k, v in new.items()}))


def time_range(attached: DataFrame) -> DataFrame:
    """case_id, first_at, last_at over the attached events."""
    return attached.groupBy("case_id").agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
