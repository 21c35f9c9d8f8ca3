"""Case exports: JSON, CSV and Markdown.

Rows are rendered as columns, in parallel; only the finished lines of one case come together.
``attached`` has the events of a case with ``pinned``, ``annotation`` and ``added_at``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebook.errors import NotFoundError, ValidationError
from casebook.functions.text import csv_field, md_field, rfc3339_text, severity_label

CSV_HEADER = "event_type,occurred_at,actor_id,source_id,severity,annotation"
FORMATS = {"json": "json", "csv": "csv", "markdown": "markdown", "md": "markdown"}


# Headings and notes of a Markdown report.
TITLE, ABOUT, EVENTS, PINNED = "Investigation Report", "Description", "Event Timeline", "Pinned Events"
NO_DESCRIPTION, NO_EVENTS, NO_NOTE = "_No description provided._", "_No events attached to this case._", "_No annotation_"


@dataclass(frozen=True)
class CaseHead:
    case_id: str
    name: str
    created_by: str
    created_at: str
    description: str = ""
    status: str = "open"


def format_named(name: str) -> str:
    if name.lower() not in FORMATS:
        raise ValidationError(f"unknown export format {name!r}")
    return FORMATS[name.lower()]


def attach(case_events: DataFrame, events: DataFrame, missing_ok: bool = False) -> DataFrame:
    """Case events with their events; an event that is missing is an error, or left out."""
    if not missing_ok:
        gone = case_events.join(events, "event_id", "left_anti").select("event_id").first()
        if gone is not None:
            raise NotFoundError(f"event {gone[0]} not found")
    return case_events.join(events, "event_id")


def _place(attached: DataFrame) -> Column:
    """The row's number in its case, in order of attachment."""
    return F.row_number().over(W.partitionBy("case_id").orderBy("added_at", "event_id"))


def csv_lines(attached: DataFrame) -> DataFrame:
    """case_id, n, line."""
    fields = [csv_field("event_type"), rfc3339_text("occurred_at"), csv_field("actor_id"), csv_field("source_id"), severity_label("severity"), csv_field("annotation")]
    return attached.select("case_id", _place(attached).alias("n"), F.concat_ws(",", *fields).alias("line"))


def markdown_lines(attached: DataFrame) -> DataFrame:
    """case_id, n, line of the event table."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    row = attached.withColumn("n", _place(attached))
    cells = [
        F.col("n").cast("string"), md_field("event_type"), rfc3339_text("occurred_at"), md_field(F.coalesce("actor_id", F.lit("-"))),
        md_field("source_id"), severity_label("severity"), F.when(F.col("pinned"), "Yes").otherwise("No"), md_field(dash("annotation")),
    ]
    return row.select("case_id", "n", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def pinned_lines(attached: DataFrame) -> DataFrame:
    note = F.coalesce(F.nullif(F.col("annotation"), F.lit("")), F.lit(NO_NOTE))
    line = F.concat(F.lit("- **"), "event_type", F.lit("** ("), rfc3339_text("occurred_at"), F.lit("): "), note)
    return attached.withColumn("n", _place(attached)).where("pinned").select("case_id", "n", line.alias("line"))


def json_entries(attached: DataFrame) -> DataFrame:
    """case_id, n, entry: one JSON object of the attachment and the event, times to the microsecond."""
    attached = attached.withColumn("n", _place(attached))
    times = {f.name: rfc3339_text(f.name) for f in attached.schema if f.dataType.typeName().startswith("timestamp")}
    attached = attached.withColumns(times)
    own = ("case_id", "event_id", "pinned", "annotation", "added_at")
    event = [c for c in attached.columns if c not in (*own, "n") or c == "event_id"]
    return attached.select("case_id", "n", F.to_json(F.struct(F.struct(*own).alias("case_event"), F.struct(*event).alias("event"))).alias("entry"))


def _lines(df: DataFrame, column: str = "line") -> list[str]:
    return [r[0] for r in df.orderBy("n").select(column).collect()]


def render(head: CaseHead, attached: DataFrame, name: str, exported_at: str) -> str:
    """One case's export as text."""
    kind = format_named(name)
    attached = attached.where(F.col("case_id") == head.case_id)
    if kind == "csv":
        return "\n".join([CSV_HEADER, *_lines(csv_lines(attached))]) + "\n"
    if kind == "json":
        entries = [json.loads(x) for x in _lines(json_entries(attached), "entry")]
        return json.dumps({"case": head.__dict__, "events": entries, "exported_at": exported_at}, indent=2)
    table, pinned = _lines(markdown_lines(attached)), _lines(pinned_lines(attached))
    out = [
        f"# {TITLE}: {head.name}\n", f"**Status:** {head.status.capitalize()}  ", f"**Created by:** {head.created_by}  ",
        f"**Created at:** {head.created_at}  ", f"**Exported at:** {exported_at}  \n", f"## {ABOUT}\n",
        (head.description or NO_DESCRIPTION) + "\n", f"## {EVENTS}\n",
    ]
    columns = ("#", "Event Type", "Occurred At", "Actor", "Source", "Severity", "Pinned", "Annotation")
    rows = [f"| {' | '.join(columns)} |", "|" + "|".join("-" * (len(c) + 2) for c in columns) + "|", *table]
    out += ["\n".join(rows) + "\n"] if table else [NO_EVENTS + "\n"]
    if pinned:
        out += [f"## {PINNED}\n", "\n".join(pinned) + "\n"]
    return "\n".join(out) + "\n"
