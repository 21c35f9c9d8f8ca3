"""Online sequence detection: a state machine for each actor, for patterns with ``same_actor``.

Events must arrive in order for each actor; an event that is not after the last one seen is dropped. Unlike the batch
operator, which tries again from every possible first event, the stream keeps the open attempts of an actor
that can still be completed, and forgets the actor when the watermark has passed the pattern's whole time after the last event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casebook.errors import ValidationError
from casebook.functions.text import glob_matches, present
from casebook.operators.sequences import Pattern

OUT = "pattern string, actor_id string, started_at timestamp, ended_at timestamp, event_ids string"
STATE = "attempts string"
SECOND = 1_000_000


def advance(attempts: list[list], event: tuple[int, int, str], pattern: Pattern) -> list | None:
    """Feed one event (microseconds, id, type) to open attempts, in place; a completed attempt is returned and clears the others.

    An attempt is a list of (microseconds, id). Attempts are in order of their first event, so the first one completed
    is the one that the batch operator reports.
    """
    at, event_id, kind = event
    steps, kept, done = pattern.steps, [], None
    for attempt in attempts:
        step = steps[len(attempt)]
        if at - attempt[0][0] > pattern.max_total_duration_secs * SECOND or (step.max_gap_secs is not None and at - attempt[-1][0] > step.max_gap_secs * SECOND):
            continue
        if glob_matches(step.event_type_pattern, kind):
            attempt = [*attempt, (at, event_id)]
            if len(attempt) == len(steps):
                done = attempt
                break
        kept.append(attempt)
    if done is None and glob_matches(steps[0].event_type_pattern, kind):
        kept.append([(at, event_id)])
        done = kept.pop() if len(steps) == 1 else None
    attempts[:] = [] if done else kept
    return done


def detect(events: DataFrame, pattern: Pattern, late: str = "1 hour") -> DataFrame:
    """Matches of a stream of events (event_id, event_type, occurred_at, actor_id); events more than ``late`` behind the newest are dropped."""
    import json

    if not pattern.same_actor or not pattern.steps:
        raise ValidationError("online detection needs steps and a pattern by actor")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        attempts, last = json.loads(state.get[0]) if state.exists else ([], [-(1 << 63), 0])
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, event_id, kind in zip(rows["at"], rows["event_id"], rows["event_type"], strict=True):
            now = [at.value // 1000, int(event_id)]
            if now <= last:
                continue
            last = now
            done = advance(attempts, (*last, kind), pattern)
            if done:
                out.append((pattern.name, key[0], pd.Timestamp(done[0][0], unit="us"), pd.Timestamp(done[-1][0], unit="us"), ",".join(str(i) for _, i in done)))
        state.update((json.dumps((attempts, last)),))
        state.setTimeoutTimestamp(last[0] // 1000 + 1000 * max(1, pattern.max_total_duration_secs) + 1)
        yield pd.DataFrame(out, columns=["pattern", "actor_id", "started_at", "ended_at", "event_ids"])

    rows = events.select("event_id", "event_type", F.col("occurred_at").cast("timestamp").alias("at"), present("actor_id").alias("actor_id")).where("actor_id is not null").withWatermark("at", late)
    return rows.groupBy("actor_id").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
