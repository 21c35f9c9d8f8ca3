"""Replay: events in order with the delay before each, and an iterator that paces them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebook.errors import ValidationError
from casebook.operators.entities import links
from casebook.operators.timeline import in_window
from casebook.schema import REPLAY_MAX_DELAY_MS


def schedule(events: DataFrame, speed: float = 1.0, start: datetime | None = None, end: datetime | None = None, source_id: str | None = None, entity: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """event_id, occurred_at, delay_ms: the gap to the event before, divided by ``speed`` and capped; speed 0 has no delays.

    ``entity`` is (observations, entity_type, identifier) and keeps the events of that entity. The gap is found
    per day and, for the first event of a day, from the last event of the days before, so
    no partition holds more than a day.
    """
    if speed < 0:
        raise ValidationError("speed must not be negative")
    rows = in_window(events, start, end)
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    if entity is not None:
        rows = rows.join(links(*entity).select("event_id").distinct(), "event_id", "left_semi")
    rows = rows.select("event_id", "occurred_at", F.to_date("occurred_at").alias("day"))
    days = rows.groupBy("day").agg(F.max("occurred_at").alias("last_at"))
    days = days.select(F.col("day").alias("_day"), F.lag("last_at").over(W.orderBy("day")).alias("before_day"))  # one row a day
    before = F.lag("occurred_at").over(W.partitionBy("day").orderBy("occurred_at", "event_id"))
    rows = rows.withColumn("before", before).join(days, F.col("day") == F.col("_day")).withColumn("before", F.coalesce("before", "before_day"))
    gap = F.floor((F.unix_micros(F.col("occurred_at").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1000)
    delay = F.lit(0) if not speed else F.coalesce(F.least(F.lit(REPLAY_MAX_DELAY_MS), F.floor(F.greatest(F.lit(0), gap) / F.lit(float(speed)))), F.lit(0))
    return rows.select("event_id", "occurred_at", delay.cast("long").alias("delay_ms"))


def frames(events: DataFrame, speed: float = 1.0, sleep: Callable[[float], None] = time.sleep, **window: object) -> Iterator[tuple[str, str | None, str]]:
    """(kind, id, data): an ``event`` frame for each event, paced, then ``done`` with the total. Rows come partition by partition."""
    plan = schedule(events, speed, **window).join(events.drop("occurred_at"), "event_id").orderBy("occurred_at", "event_id")
    total = 0
    for row in plan.select("event_id", "delay_ms", F.to_json(F.struct(*events.columns)).alias("data")).toLocalIterator():
        if row["delay_ms"]:
            sleep(row["delay_ms"] / 1000)
        total += 1
        yield "event", str(row["event_id"]), row["data"]
    yield "done", None, f'{{"total":{total}}}'
