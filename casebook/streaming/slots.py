"""Online detection of patterns over all actors, or over very busy ones, by time slot.

The state of `online.detect` is an actor's, so a pattern over all actors would be one state. Here events go, as in the batch operator, to the slot of their time (as long as the
pattern's bound) and, as look-ahead, to the slot before; the key of the state is (actor, slot), so a pattern over all actors is dealt to many states. A slot keeps a list of the events its steps
take and has one timer: when the watermark has passed the end of the slot after it, all chains that start in the slot are known. They are given out as candidates, and the state goes.
Events may come in any order within the watermark; later ones are dropped by Spark.

`collect` stores candidates batch by batch, a batch that is run again replacing itself, and `matches` chooses among them by the batch operator's `chosen`.
The last slots of a bounded stream are closed by an event that is later than their timers, of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from casebook.errors import ValidationError
from casebook.operators import sequences
from casebook.operators.sequences import Pattern

OUT = "actor_id string, slot long, times array<long>, ids array<long>"
ROWS = "at long, id long, steps long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000


def chains(at: np.ndarray, ids: np.ndarray, steps: np.ndarray, pattern: Pattern, until: int) -> list[tuple[list[int], list[int]]]:
    """Times and ids of the chains that start before ``until``; ``steps`` has a bit for each step that takes the event. Equal events (sent twice) count once."""
    order = np.lexsort((ids, at))
    at, ids, steps = at[order], ids[order], steps[order]
    if len(at):
        new = np.append(True, (at[1:] != at[:-1]) | (ids[1:] != ids[:-1]))
        at, ids, steps = at[new], ids[new], steps[new]
    n = len(pattern.steps)
    places = [np.flatnonzero(steps >> k & 1) for k in range(n)]
    found = places[0][at[places[0]] < until][:, None]
    for k in range(1, n):
        nearest = np.searchsorted(places[k], found[:, -1], side="right")
        found, nearest = found[nearest < len(places[k])], nearest[nearest < len(places[k])]
        following = places[k][nearest]
        gap = pattern.steps[k].max_gap_secs
        near = np.ones(len(found), bool) if gap is None else at[following] - at[found[:, -1]] <= gap * SECOND
        found = np.column_stack([found, following])[near]
    found = found[at[found[:, -1]] - at[found[:, 0]] <= pattern.max_total_duration_secs * SECOND]
    return [(at[row].tolist(), ids[row].tolist()) for row in found]


class Slots(StatefulProcessor):
    """The list of a slot's events, and the timer that closes it."""

    def __init__(self, pattern: Pattern):
        self.pattern, self.bound = pattern, max(1, pattern.max_total_duration_secs * SECOND)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", ROWS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.rows.appendList(list(zip(part["us"].tolist(), part["id"].tolist(), part["steps"].tolist(), strict=True)))
        closes = -(-(key[1] + 2) * self.bound // 1000)
        if closes not in list(self.handle.listTimers()):
            self.handle.registerTimer(closes)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get())
        self.rows.clear()
        at, ids, steps = (np.array(c, np.int64) for c in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
        found = chains(at, ids, steps, self.pattern, (key[1] + 1) * self.bound)
        if found:
            yield pd.DataFrame({"actor_id": key[0], "slot": key[1], "times": [t for t, _ in found], "ids": [i for _, i in found]})

    def close(self) -> None:
        pass


def candidates(events: DataFrame, pattern: Pattern, late: str = "1 hour") -> DataFrame:
    """Candidates of a stream of events (event_id long, event_type, occurred_at, actor_id). The session's state store must be `PROVIDER`."""
    if not pattern.steps:
        raise ValidationError("online detection needs steps")
    timed = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late)
    rows = sequences.relevant(timed, pattern, "at")
    steps = sum((F.col(f"m{k}").cast("long") * (1 << k) for k in range(1, len(pattern.steps))), F.col("m0").cast("long"))
    # an event that only the first step takes starts chains in its own slot alone, but is cheap to keep in both
    dealt = rows.select("at", "actor_id", F.unix_micros("at").alias("us"), "id", steps.alias("steps"), F.explode(F.array("_own", F.col("_own") - 1)).alias("slot"))
    return dealt.groupBy("actor_id", "slot").transformWithStateInPandas(Slots(pattern), OUT, "Append", "EventTime")


def collect(found: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stores candidates under ``out``, a folder a batch."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = found.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def matches(spark: SparkSession, out: str, pattern: Pattern) -> DataFrame:
    """What `sequences.detect` finds, from the stored candidates."""
    chain = F.zip_with("times", "ids", lambda t, i: F.struct(F.timestamp_micros(t).cast("timestamp_ntz").alias("ts"), i.alias("id")))
    return sequences.chosen(spark.read.schema(f"{OUT}, batch long").parquet(out).select("actor_id", "slot", chain.alias("chain")), pattern)
