"""Timelines: filtered, ordered, keyset-paged views of the event table.

Filters are conjunctive and only those given are applied. On tables partitioned by
``occurred_date`` the window also becomes a predicate on that column, which Catalyst does not
derive from a timestamp range by itself. A page is a top-k (no global sort), one row
longer than asked for, to tell whether more follow.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.errors import NotFoundError, ValidationError
from casebook.functions.text import canonical_ip, comma_items, lexemes
from casebook.schema import TIMELINE_LIMIT, TIMELINE_MAX

SEARCHED = ("event_type", "source_id", "actor_id", "actor_name", "subject_id", "subject_name", "object_id", "object_name", "source_name", "hostname")


def _stamp(t: datetime) -> Column:
    return F.lit(t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t).cast("timestamp_ntz")


@dataclass(frozen=True)
class Filters:
    """What a timeline may be filtered by; None, and an empty list or search, filter nothing."""

    start: datetime | None = None
    end: datetime | None = None
    event_types: list[str] = field(default_factory=list)
    actor_id: str | None = None
    source_id: str | None = None
    min_severity: int | None = None
    src_ip: str | None = None
    search: str = ""
    tags: list[str] = field(default_factory=list)

    @staticmethod
    def of_text(event_types: str = "", tags: str = "", **more: object) -> Filters:
        """Filters whose lists are written with commas."""
        return Filters(event_types=comma_items(event_types), tags=comma_items(tags), **more)


def encode_cursor(occurred_at: datetime, event_id: object) -> str:
    raw = f"{occurred_at.replace(tzinfo=occurred_at.tzinfo or UTC).isoformat()},{event_id}".encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def cursor_of(occurred_at: Column | str, event_id: Column | str) -> Column:
    """`encode_cursor` as a column, times to the microsecond."""
    raw = F.concat(F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00,"), F.col(event_id).cast("string") if isinstance(event_id, str) else event_id.cast("string"))
    plain = F.replace(F.base64(F.encode(raw, "UTF-8")), F.lit("\r\n"), F.lit(""))
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    try:
        raw = base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True).decode()
        at, event_id = raw.split(",", 1)
        return datetime.fromisoformat(at), event_id
    except ValueError as e:
        raise ValidationError(f"malformed cursor: {cursor!r}") from e


def in_window(df: DataFrame, start: datetime | None, end: datetime | None, closed: bool = False) -> DataFrame:
    """Rows of [start, end), or [start, end] if ``closed``."""
    if start is not None and end is not None and not (start < end or closed and start == end):
        raise ValidationError("start must be before end")
    tests = [F.col("occurred_at") >= _stamp(start)] if start is not None else []
    if end is not None:
        tests.append(F.col("occurred_at") <= _stamp(end) if closed else F.col("occurred_at") < _stamp(end))
    if "occurred_date" in df.columns:
        tests += [F.col("occurred_date") >= F.lit(start.date())] if start is not None else []
        tests += [F.col("occurred_date") <= F.lit(end.date())] if end is not None else []
    return df.where(reduce(Column.__and__, tests)) if tests else df


def event_lexemes(df: DataFrame, split_punct: bool = False) -> Column:
    """The stored lexemes if the table has them, else those of the searched columns it has."""
    return F.col("lexemes") if "lexemes" in df.columns else lexemes(*(c for c in SEARCHED if c in df.columns), split_punct=split_punct)


def matches(df: DataFrame, query: str, split_punct: bool = False) -> Column:
    """All tokens of the query occur as whole tokens; a query without tokens matches nothing."""
    wanted = sorted(set(query.lower().split()))
    return F.lit(False) if not wanted else F.size(F.array_except(F.array(*map(F.lit, wanted)), event_lexemes(df, split_punct))) == 0


def filtered(df: DataFrame, by: Filters) -> DataFrame:
    tests = []
    if by.event_types:
        tests.append(F.col("event_type").isin(by.event_types))
    if by.actor_id is not None:
        tests.append(F.col("actor_id") == by.actor_id)
    if by.source_id is not None:
        tests.append(F.col("source_id") == by.source_id)
    if by.min_severity is not None:
        tests.append(F.col("severity") >= by.min_severity)
    if by.src_ip is not None:
        tests.append(canonical_ip("src_ip") == canonical_ip(F.lit(by.src_ip)))
    if by.search.strip():
        tests.append(matches(df, by.search))
    if by.tags:
        tests.append(F.size(F.array_except(F.array(*map(F.lit, by.tags)), "tags")) == 0)
    df = in_window(df, by.start, by.end)
    return df.where(reduce(Column.__and__, tests)) if tests else df


def after(at: datetime, event_id: object, newest_first: bool = False) -> Column:
    """Rows behind a cursor. Written without row comparison, so the time bound reaches the scan."""
    t, e = _stamp(at), F.lit(event_id)
    if newest_first:
        return (F.col("occurred_at") <= t) & ((F.col("occurred_at") < t) | (F.col("event_id") < e))
    return (F.col("occurred_at") >= t) & ((F.col("occurred_at") > t) | (F.col("event_id") > e))


def page(df: DataFrame, by: Filters = Filters(), limit: int = TIMELINE_LIMIT, cursor: str | None = None, newest_first: bool = False) -> DataFrame:
    """Up to ``limit + 1`` rows in order; a row beyond ``limit`` says that more follow."""
    if not 1 <= limit <= TIMELINE_MAX:
        raise ValidationError(f"limit must be between 1 and {TIMELINE_MAX}")
    out = filtered(df, by)
    if cursor is not None:
        at, event_id = decode_cursor(cursor)
        out = out.where(after(at, int(event_id) if dict(df.dtypes)["event_id"] == "bigint" else event_id, newest_first))
    order = [F.col(c).desc() if newest_first else F.col(c).asc() for c in ("occurred_at", "event_id")]
    return out.orderBy(*order).limit(limit + 1)


def fetch_page(df: DataFrame, by: Filters = Filters(), limit: int = TIMELINE_LIMIT, cursor: str | None = None, newest_first: bool = False) -> tuple[list, str | None]:
    """The rows of a page and the next page's cursor, None on the last page."""
    rows = page(df, by, limit, cursor, newest_first).collect()
    more, rows = len(rows) > limit, rows[:limit]
    return rows, encode_cursor(rows[-1]["occurred_at"], rows[-1]["event_id"]) if more else None


def picked(df: DataFrame, page: DataFrame) -> DataFrame:
    """The events of a page of ids (event_id, occurred_at; as many as a limit allows): their ids and times reach the scan as filters."""
    rows = page.select("event_id", "occurred_at").collect()
    if not rows:
        return df.limit(0)
    times = [r["occurred_at"] for r in rows]
    return in_window(df, min(times), max(times), closed=True).where(F.col("event_id").isin([r["event_id"] for r in rows]))


def event_by_id(df: DataFrame, event_id: object) -> DataFrame:
    return df.where(F.col("event_id") == event_id)


def fetch_event(df: DataFrame, event_id: object) -> object:
    row = event_by_id(df, event_id).first()
    if row is None:
        raise NotFoundError(f"event {event_id} not found")
    return row
