"""Continuous ingest: payload files in a folder, parsed, normalised and appended batch by batch.

Lateness is not bounded for appends, so no watermark is needed there; `lagged` reports how late events
arrive, and `counted` shows the windowed form, which does need one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casebook.functions.text import present
from casebook.operators.entities import observations
from casebook.operators.normalize import normalized, stored
from casebook.sources import parsers
from casebook.sources.files import content_type
from casebook.sources.indexes import Indexes

PAYLOAD = "path string, modificationTime timestamp, length long, content binary"


def payload_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Each new file as one payload."""
    files = spark.readStream.format("binaryFile").schema(PAYLOAD).option("maxFilesPerTrigger", max_files).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("payload"), content_type(F.col("path")).alias("content_type"), F.abs(F.xxhash64("path", "content")).alias("raw_event_id"))


def ingest(payloads: DataFrame, out: str, checkpoint: str, now: Callable[[], Column] = lambda: F.current_timestamp().cast("timestamp_ntz"), parser_id: str | None = None, trigger: dict | None = None, indexes: Indexes | None = None) -> StreamingQuery:
    """Events to ``out/events`` (by date), their payloads to ``out/raw``, failed payloads and rejected rows to ``out/errors`` and ``out/rejected``.

    Each batch is a folder of its own that is overwritten if the batch is run again, so a restart repeats nothing.
    A batch is parsed once: the parsed rows are written, and what is kept, rejected or failed is read from there. ``indexes`` are kept up to date with the events, by the same batch numbers.
    """

    def batch(df: DataFrame, number: int) -> None:
        into = lambda kind: f"{out}/{kind}/batch={number}"
        df.write.mode("overwrite").parquet(into("raw"))
        raw = df.sparkSession.read.schema(df.schema).parquet(into("raw"))
        rows = parsers.parse(raw, parser_id, now=now())
        rows.write.mode("overwrite").parquet(into("parsed"))
        parsed = df.sparkSession.read.schema(rows.schema).parquet(into("parsed"))
        good, bad = normalized(parsed.where("error is null"), now())
        stored(good).write.mode("overwrite").partitionBy("occurred_date").parquet(into("events"))
        if indexes is not None:
            indexes.update(df.sparkSession.read.schema(stored(good).schema).parquet(into("events")), number, with_hints=True)
        bad.select("raw_event_id", "ordinal", "rejected_because").write.mode("overwrite").parquet(into("rejected"))
        parsed.where("error is not null").select("raw_event_id", "ordinal", "error").write.mode("overwrite").parquet(into("errors"))

    writer = payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def lagged(events: DataFrame) -> DataFrame:
    """Adds lag_seconds, arrival minus occurrence."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return events.withColumn("lag_seconds", (us("received_at") - us("occurred_at")) / 1_000_000)


def counted(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events a window and type; with a watermark, so that state is bounded on a stream."""
    timed = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n_events")).select("window.start", "window.end", "event_type", "n_events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """actor_id, started_at, ended_at, n_events of each run of an actor's events with less than ``gap`` between neighbours.

    On a stream a session is given out once the watermark has passed its last event by the gap; an event further behind than ``late`` is dropped, and counted (`late_rows`).
    """
    timed = events.select(present("actor_id").alias("actor_id"), F.col("occurred_at").cast("timestamp").alias("at")).where("actor_id is not null").withWatermark("at", late)
    found = timed.groupBy("actor_id", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count("*").alias("n_events"))
    return found.select("actor_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")), "n_events")


def late_rows(query: StreamingQuery) -> int:
    """How many rows a query's operators have dropped, over all batches it still reports, because they came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def linked(events: DataFrame, seeds: DataFrame, window_seconds: int, late: str = "1 hour") -> DataFrame:
    """from_id, event_id, entity_type, identifier: what `graph.chain` finds one level from each of the seeds (events of the same stream or another), as both arrive.

    Both sides have a watermark and the condition bounds the time between them, so each side's state is that of a window and the lateness, whatever the stream's length.
    Rows meet by entity and time slot of half the window, in which a seed stands three times (its own slot and those beside it): a hot entity meets only what is near in time, in many tasks.
    """
    half = f"interval {window_seconds / 2:f} seconds"
    slot = lambda at: F.floor(F.unix_micros(at) / (window_seconds * 500_000)).cast("long")
    sides = []
    for df, id_name, at in ((events, "event_id", "at"), (seeds, "from_id", "from_at")):
        seen = observations(df).select(F.col("event_id").alias(id_name), F.col("entity_type").alias(f"{at}_type"), F.col("identifier").alias(f"{at}_identifier"), F.col("occurred_at").cast("timestamp").alias(at))
        sides.append(seen.withWatermark(at, late))
    timed = sides[0].withColumn("slot", slot("at"))
    near_slots = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: slot("from_at") + k))
    asked = sides[1].withColumn("from_slot", near_slots)
    near = F.expr(f"at_type = from_at_type and at_identifier = from_at_identifier and slot = from_slot and event_id <> from_id and at >= from_at - {half} and at < from_at + {half}")
    return timed.join(asked, near).select("from_id", "event_id", F.col("at_type").alias("entity_type"), F.col("at_identifier").alias("identifier"))
