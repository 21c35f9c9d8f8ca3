r"""Payload parsers: rows with a payload in, one row for each event out.

Every parser takes a DataFrame with ``payload`` (text) and adds ``ordinal``, ``error`` and the parsed
columns (`PARSED`). One bad item fails its payload: such a payload has a single row with ``error`` set.
`REGISTRY` lists the parsers in order of detection; `parse` dispatches by explicit id
or by detection, and `raise_errors` turns error rows into an exception.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.errors import ParseError
from casebook.functions.text import flexible_time, rfc3339, severity_of_name, severity_of_priority, severity_of_words, trimmed, utc

HINTS = "array<struct<key_type:string,key_value:string>>"
PARSED = {
    "event_type": "string", "severity": "int", "occurred_at": "timestamp_ntz", "observed_at": "timestamp_ntz",
    "actor_id": "string", "actor_name": "string", "actor_type": "string",
    "subject_id": "string", "subject_name": "string", "subject_type": "string",
    "object_id": "string", "object_name": "string", "object_type": "string",
    "src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "string",
    "device_id": "string", "device_name": "string", "device_type": "string", "hostname": "string",
    "tags": "array<string>", "custom_fields": "string", "hints": HINTS,
}
# The fields a JSON event may have, and those inside its parts with the columns they fill.
TOP = ("event_type", "severity", "occurred_at", "observed_at", "actor", "subject", "object", "network", "device", "tags")
PARTS = {
    **{p: {"id": f"{p}_id", "name": f"{p}_name", "type": f"{p}_type"} for p in ("actor", "subject", "object")},
    "network": {"src_ip": "src_ip", "dst_ip": "dst_ip", "src_port": "src_port", "dst_port": "dst_port", "protocol": "protocol"},
    "device": {"device_id": "device_id", "device_name": "device_name", "device_type": "device_type", "hostname": "hostname"},
}
# Headers that a CSV column may have.
CSV_HEADERS = {
    "event_type": ("event_type", "type"), "occurred_at": ("occurred_at", "timestamp", "time", "date"),
    "actor_id": ("actor_id", "user", "user_id"), "actor_name": ("actor_name", "username"),
    "src_ip": ("src_ip", "source_ip", "ip"), "dst_ip": ("dst_ip", "dest_ip", "destination_ip"),
    "hostname": ("hostname", "host"), "severity": ("severity", "level"),
}
FIELD_END, LINE_END = "\ufdd0", "\ufdd1"  # no characters of any text
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _carried(df: DataFrame) -> list[str]:
    """What parsed rows keep of their payload's row: not the payload, or one of n lines would cost its square."""
    return [c for c in df.columns if c != "payload"]


def _finished(df: DataFrame, carried: list[str], **columns: Column) -> DataFrame:
    """The parsed columns in order; those not given are null, tags empty and hints empty."""
    empty = {"tags": F.array().cast("array<string>"), "hints": F.array().cast(HINTS)}
    ok = F.col("error").isNull()
    made = [F.when(ok, columns.get(c, empty.get(c, F.lit(None)))).cast(kind).alias(c) for c, kind in PARSED.items()]
    return df.select(*carried, "ordinal", "error", *made)


def _hints(**kinds: Column) -> Column:
    made = F.array(*(F.struct(F.lit(k.rstrip("_")).alias("key_type"), v.alias("key_value")) for k, v in kinds.items()))
    return F.filter(made, lambda h: h["key_value"].isNotNull() & (h["key_value"] != ""))


def _opened(df: DataFrame, items: Column, whole: Column, check: Callable[[Column], Column], none: Column) -> DataFrame:
    """Adds ordinal, _item and error: a row for each item, or one row for the first bad item (or for a payload that is bad as a whole).

    Items are checked before they are exploded, so a payload fails as a whole without a shuffle. ``none`` stands for an item where there is none.
    """
    carried = _carried(df)
    rows = df.withColumns({"_whole": whole, "_items": items})
    rows = rows.withColumn("_bad", F.when(F.col("_whole").isNull(), F.array_position(F.transform("_items", lambda x: check(x).isNotNull()), True)))
    kept = F.when(F.col("_whole").isNotNull(), F.array(none)).when(F.col("_bad") > 0, F.slice("_items", F.col("_bad").cast("int"), F.lit(1))).otherwise(F.col("_items"))
    rows = rows.select(*carried, "_whole", "_bad", F.posexplode(kept).alias("_pos", "_item"))
    error = F.when(F.col("_whole").isNotNull(), F.col("_whole")).when(F.col("_bad") > 0, check(F.col("_item")))
    return rows.select(*carried, F.when(F.col("_bad") > 0, F.col("_bad").cast("int") - 1).otherwise(F.col("_pos")).alias("ordinal"), "_item", error.alias("error"))


# ---- JSON ----------------------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(item: Column, path: str) -> Column:
    return F.try_variant_get(item, path, "variant")


def _text(item: Column, path: str) -> Column:
    return F.when(_kind(_at(item, path)) == "STRING", F.try_variant_get(item, path, "string"))


def _not_text(item: Column, path: str) -> Column:
    """There, but neither a string nor null."""
    v = _at(item, path)
    return v.isNotNull() & ~_kind(v).isin("STRING", "VOID")


def parse_json(df: DataFrame, now: Column | None = None) -> DataFrame:
    """One object or an array of objects; unknown top-level fields become ``custom_fields``."""
    carried = _carried(df)
    body = trimmed("payload")
    document = F.try_parse_json(body)
    is_list = F.startswith(body, F.lit("["))
    items = F.when(is_list, F.try_variant_get(document, "$", "array<variant>")).otherwise(F.array(document))
    whole = F.when(F.coalesce(body, F.lit("")) == "", "the payload is blank").when(document.isNull() | (~is_list & ~F.startswith(_kind(document), F.lit("OBJECT"))), "invalid JSON")
    texts = ["$.severity", "$.observed_at", *(f"$.{p}.{k}" for p, fields in PARTS.items() for k in fields if not k.endswith("_port"))]
    names = "|".join(sorted({t.rsplit(".", 1)[1] for t in texts}))
    # one look at the item's schema: only if a field of such a name, anywhere, is no text do the fields themselves have to be looked at
    doubtful = lambda item: F.coalesce(F.rlike(_kind(item), F.lit(f"(?:^|[<, ])(?:{names}): (?!STRING|VOID)")), F.lit(True))

    def check(item: Column) -> Column:
        observed = F.try_variant_get(item, "$.observed_at", "string")
        return (
            F.when(~F.startswith(_kind(item), F.lit("OBJECT")), "not an object")
            .when(_text(item, "$.event_type").isNull(), "missing field event_type")
            .when(rfc3339(_text(item, "$.occurred_at")).isNull(), "missing or invalid occurred_at")
            .when(doubtful(item) & reduce(Column.__or__, (_not_text(item, p) for p in texts)), "a field has the wrong type")
            .when(observed.isNotNull() & rfc3339(observed).isNull(), "invalid observed_at")
        )

    # an empty array has no rows
    rows = _opened(df, items, whole, check, F.try_parse_json(F.lit("{}")))
    item = F.col("_item")
    # a text that is none has failed the check
    found = {column: F.try_variant_get(item, f"$.{p}.{k}", "int" if k.endswith("_port") else "string") for p, fields in PARTS.items() for k, column in fields.items()}
    top = lambda k: F.try_variant_get(item, f"$.{k}", "string")
    extra = F.map_filter(F.try_variant_get(item, "$", "map<string,variant>"), lambda k, _: ~k.isin(*TOP))
    sorted_extra = F.map_from_entries(F.array_sort(F.transform(F.map_entries(extra), lambda e: F.struct(e["key"], F.to_json(e["value"]).alias("value")))))
    custom = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(sorted_extra), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    hints = _hints(identity=found["actor_id"], ip=found["src_ip"], device=found["device_id"], host=found["hostname"])
    return _finished(
        rows, carried, event_type=top("event_type"), severity=severity_of_name(top("severity")), occurred_at=rfc3339(top("occurred_at")), observed_at=rfc3339(top("observed_at")), tags=F.coalesce(F.try_variant_get(item, "$.tags", "array<string>"), F.array().cast("array<string>")), custom_fields=custom, hints=hints, **found,
    )


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


# ---- CSV -----------------------------------------------------------------------------------------


def _read_odd(payload: pd.Series) -> pd.Series:
    """Records of payloads in which quotes stand elsewhere than around fields, by the standard reader; null for null."""
    return payload.map(lambda p: None if p is None else [r for r in csv.reader(io.StringIO(p, newline=""), strict=False) if r])


def _with(df: DataFrame, **columns: str) -> DataFrame:
    """Adds columns written in SQL: long expressions are parsed at once, not built piece by piece."""
    return df.selectExpr("*", *(f"{text} as {name}" for name, text in columns.items()))


def csv_records(df: DataFrame) -> DataFrame:
    """``df`` (with _p, a payload) with _records: the cells of all lines that are not empty, without their quotes.

    Between quotes a comma or a line end is text. Split at its quotes, a payload has what is outside them at every other place, if every quote opens or closes a
    field (or is doubled in one): separators are marked there, and the whole is split at the marks. The few payloads of other forms are read by `_read_odd`.
    """
    rows = _with(df, _parts="""split(_p, '"')""")
    rows = _with(rows, _outside="filter(_parts, (x, i) -> i % 2 = 0)")
    apart = r"forall(transform(_outside, (x, i) -> x = '' or ((i = 0 or x rlike r'^[,\r\n]') and (i = size(_outside) - 1 or x rlike r'[,\r\n]\z'))), ok -> ok)"
    rows = _with(rows, _plain=f"size(_parts) % 2 = 1 and {apart} and not _p rlike '[{FIELD_END}{LINE_END}]'")
    rows = _with(rows, _marked=f"""array_join(transform(_parts, (x, i) -> if(i % 2 = 0, translate(x, ',\\n\\r', '{FIELD_END}{LINE_END}{LINE_END}'), x)), '"')""")
    bare = """if(startswith(c, '"'), replace(substring(c, 2, length(c) - 2), '""', '"'), c)"""
    rows = rows.withColumn("_odd", F.pandas_udf(_read_odd, "array<array<string>>")(F.expr("if(_plain, null, _p)")))
    found = f"if(_plain, transform(filter(split(_marked, '{LINE_END}'), r -> r <> ''), r -> transform(split(r, '{FIELD_END}'), c -> {bare})), _odd)"
    return _with(rows, _records=found).drop("_parts", "_outside", "_plain", "_marked", "_odd")


def parse_csv(df: DataFrame, now: Column | None = None) -> DataFrame:
    """First row headers. A time that is missing or malformed is ``now``; the default type is csv.event. Of columns for one field the last that is not blank counts."""
    carried = _carried(df)
    trim = lambda text: f"regexp_replace({text}, r'(?U)^\\s+|\\s+$', '')"
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    rows = csv_records(df.select(*carried, F.coalesce("payload", F.lit("")).alias("_p"))).drop("_p")
    rows = _with(rows, _headers="coalesce(get(_records, 0), cast(array() as array<string>))", _none="size(_records) = 0", _rest="slice(_records, 2, greatest(size(_records) - 1, 0))")
    rows = _with(rows, _names=f"transform(_headers, h -> lower({trim('h')}))")
    # where each field's cells are is found once a payload
    places = lambda test: f"filter(transform(_names, (h, i) -> if({test}, i, null)), i -> i is not null)"
    at = {f"_at_{c}": places(f"h in ({listed(known)})") for c, known in CSV_HEADERS.items()}
    at["_at_custom"] = places(f"h not in ({listed(x for known in CSV_HEADERS.values() for x in known)})")
    rows = _with(rows, **at, _lines="if(_none, array(cast(array() as array<string>)), _rest)")
    rows = rows.select(*carried, "_headers", *at, "_none", F.posexplode("_lines").alias("ordinal", "_line"))
    rows = _with(rows, _cells=f"transform(_line, c -> {trim('c')})", error="if(_none, 'no line in the CSV payload', null)")
    # sorted by header and place: of equal headers the last stays
    rows = _with(rows, _entries="array_sort(filter(transform(_at_custom, i -> struct(get(_headers, i) as k, i as i, get(_cells, i) as v)), e -> e.v <> ''))")
    rows = _with(rows, _kept="filter(_entries, (e, i) -> not coalesce(get(_entries, i + 1).k = e.k, false))")
    quoted = lambda text: f"""regexp_extract(to_json(struct({text} as x)), r'(?s)^\\{{"x":(.*)\\}}$', 1)"""
    cell = {c: F.col(f"_{c}") for c in (*CSV_HEADERS, "custom_fields")}
    rows = _with(
        rows, **{f"_{c}": f"get(reverse(filter(transform(_at_{c}, i -> get(_cells, i)), x -> x <> '')), 0)" for c in CSV_HEADERS},
        _custom_fields=f"concat('{{', array_join(transform(_kept, e -> concat({quoted('e.k')}, ':', {quoted('e.v')})), ','), '}}')",
    )
    now = (F.current_timestamp() if now is None else now).cast("timestamp_ntz")
    return _finished(
        rows, carried, **{c: v for c, v in cell.items() if c not in ("event_type", "occurred_at", "severity")}, event_type=F.coalesce(cell["event_type"], F.lit("csv.event")),
        occurred_at=F.coalesce(rfc3339(cell["occurred_at"]), now), severity=severity_of_name(cell["severity"]), hints=_hints(identity=cell["actor_id"], ip=cell["src_ip"], host=cell["hostname"]),
    )


# ---- syslog --------------------------------------------------------------------------------------

PRIORITY = r"^<(\d{1,3})>"
RFC5424 = r"^1(?: |$)"
BSD = r"(?i)^(" + "|".join(MONTHS) + r")\s*(\S+) (\d\d:\d\d:\d\d)\S*(?: +(\S+)(?: (.*))?)?\s*$"
APP = r"^([A-Za-z0-9_.-]+)(?:\[[^:]*(?:: ?[^ :][^:]*)*)?: (.*)$"


def parse_syslog(df: DataFrame, now: Column | None = None, year: Column | None = None) -> DataFrame:
    """One message a line, RFC 5424 or BSD or a bare priority; BSD dates lie in ``year`` (the current one by default)."""
    carried = _carried(df)
    now = (F.current_timestamp() if now is None else now).cast("timestamp_ntz")
    year = F.year(now) if year is None else year
    kept = F.filter(F.transform(F.split("payload", r"\r?\n"), trimmed), lambda x: x != "")
    lines = F.coalesce(kept, F.array().cast("array<string>"))
    priority = lambda line: F.nullif(F.regexp_extract(line, PRIORITY, 1), F.lit("")).cast("int")
    check = lambda line: F.when(priority(line).isNull() | (priority(line) > 191), "a line has no priority")
    rows = _opened(df, lines, F.when(F.size(lines) == 0, "no line to parse"), check, F.lit(""))
    rows = rows.withColumnRenamed("_item", "_line").withColumn("_pri", priority(F.col("_line")))
    rows = rows.withColumn("_rest", F.regexp_replace("_line", PRIORITY, "")).withColumn("_body", F.ltrim("_rest"))
    rows = rows.withColumns({"_words": F.split("_body", " ", 7), "_is5424": F.rlike("_body", F.lit(RFC5424)), "_isbsd": F.rlike("_body", F.lit(BSD))})
    part = lambda k: F.nullif(F.try_element_at(F.col("_words"), F.lit(k)), F.lit("-"))
    bsd = lambda k: F.regexp_extract("_body", BSD, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(bsd(1)))
    day = F.when(bsd(2).rlike(r"^\d+$"), F.lpad(bsd(2), 2, "0"))
    stamp = F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), day, F.lit("T"), bsd(3), F.lit("Z"))
    text = bsd(5)
    app = F.when(text.rlike(r"^[A-Za-z0-9_.-]+(\[.*?)?: "), F.regexp_extract(text, r"^([A-Za-z0-9_.-]+)", 1))
    after = F.when(app.isNotNull(), F.regexp_extract(text, r"^.*?: (.*)$", 1)).otherwise(text)
    pick = lambda new, old, other: F.when(F.col("_is5424"), new).when(F.col("_isbsd"), old).otherwise(other)
    nothing = F.lit(None).cast("string")
    rows = rows.withColumns(
        {
            "_at": pick(rfc3339(part(2)), rfc3339(stamp), F.lit(None).cast("timestamp_ntz")), "_host": pick(part(3), F.nullif(bsd(4), F.lit("")), nothing),
            "_app": pick(part(4), app, nothing), "_message": pick(F.coalesce(F.try_element_at(F.col("_words"), F.lit(7)), F.lit("")), after, F.col("_rest")),
        }
    )
    custom = F.to_json(F.struct(F.col("_app").alias("app_name"), F.nullif("_message", F.lit("")).alias("message"), F.col("_pri").alias("priority")))
    return _finished(
        rows, carried, event_type=F.concat(F.lit("syslog."), F.coalesce("_app", F.lit("unknown"))), severity=severity_of_priority(F.col("_pri")), occurred_at=F.coalesce("_at", now),
        hostname=F.col("_host"), custom_fields=custom, hints=_hints(host=F.col("_host")),
    )


# ---- webhooks ------------------------------------------------------------------------------------


def parse_webhook(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Template for webhook payloads: times in several forms, severity from the type's words."""
    carried = _carried(df)
    body = trimmed("payload")
    document = F.try_parse_json(body)
    is_list = F.startswith(body, F.lit("["))
    items = F.when(is_list, F.try_variant_get(document, "$", "array<variant>")).otherwise(F.array(document))
    whole = F.when(F.coalesce(body, F.lit("")) == "", "the payload is blank").when(document.isNull(), "invalid JSON")

    def moment(item: Column) -> Column:
        kind = _kind(_at(item, "$.timestamp"))
        number = F.when(kind == "BIGINT", F.try_variant_get(item, "$.timestamp", "string"))
        fraction = F.when(kind.rlike("DECIMAL|DOUBLE|FLOAT"), F.try_variant_get(item, "$.timestamp", "double"))
        return F.coalesce(flexible_time(F.coalesce(_text(item, "$.timestamp"), number)), utc(F.timestamp_micros((fraction * 1_000_000).cast("long"))))

    rows = _opened(df, items, whole, lambda item: F.when(moment(item).isNull(), "missing or invalid timestamp"), F.try_parse_json(F.lit("{}")))
    item = F.col("_item")
    raw_type = F.coalesce(_text(item, "$.type"), F.lit("unknown"))
    user, details = F.startswith(_kind(_at(item, "$.user")), F.lit("OBJECT")), _at(item, "$.details")
    custom = F.concat(F.lit("{"), F.when(details.isNotNull(), F.concat(F.lit('"details":'), F.to_json(details), F.lit(","))).otherwise(""), F.lit('"raw_type":'), _quoted(raw_type), F.lit("}"))
    device = {c: _text(item, f"$.device.{k}") for k, c in (("id", "device_id"), ("name", "device_name"), ("type", "device_type"), ("hostname", "hostname"))}
    actor, ip = _text(item, "$.user.id"), _text(item, "$.ip")
    return _finished(
        rows, carried, event_type=F.concat(F.lit("template."), raw_type), severity=severity_of_words(raw_type), occurred_at=moment(item), actor_id=actor, actor_name=_text(item, "$.user.email"),
        actor_type=F.when(user, "user"), src_ip=ip, tags=F.array(F.lit("template")), custom_fields=custom, hints=_hints(identity=actor, ip=ip), **device,
    )


# ---- registry ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Parser:
    """``detects`` gets the payload and the content type; ``parse`` gets a DataFrame with ``payload``."""

    id: str
    content_types: tuple[str, ...]
    detects: Callable[[Column, Column], Column]
    parse: Callable[..., DataFrame]


def _one_of(kind: Column, *types: str) -> Column:
    return F.coalesce(kind.isin(*types), F.lit(False))


JSON = Parser("json_generic", ("application/json", "text/json"), lambda p, t: _one_of(t, "application/json", "text/json") | p.rlike(r"^\s*[\[{]"), parse_json)
CSV = Parser("csv_generic", ("text/csv", "application/csv"), lambda p, t: _one_of(t, "text/csv", "application/csv"), parse_csv)
SYSLOG = Parser("syslog", ("text/syslog", "text/plain"), lambda p, t: _one_of(t, "text/syslog") | p.rlike(r"^\s*<\d{1,4}>"), parse_syslog)
WEBHOOK = Parser("template", ("application/json",), lambda p, t: _one_of(t, "application/vnd.template+json"), parse_webhook)
REGISTRY = (JSON, CSV, SYSLOG)


def detected(payload: Column, content_type: Column, registry: tuple[Parser, ...] = REGISTRY) -> Column:
    """The id of the first parser that takes the payload, else null."""
    out = F.lit(None).cast("string")
    for parser in reversed(registry):
        out = F.when(F.coalesce(parser.detects(payload, content_type), F.lit(False)), parser.id).otherwise(out)
    return out


def parse(df: DataFrame, parser_id: str | None = None, registry: tuple[Parser, ...] = REGISTRY, now: Column | None = None) -> DataFrame:
    """By ``parser_id``, or each payload by the parser detected from it and its ``content_type``."""
    if parser_id is not None:
        chosen = next((p for p in registry if p.id == parser_id), None)
        if chosen is None:
            raise ParseError(f"unknown parser: {parser_id}")
        return chosen.parse(df, now=now)
    marked = df.withColumn("parser_id", detected(F.col("payload"), F.col("content_type"), registry))
    parts = [p.parse(marked.where(F.col("parser_id") == p.id), now=now) for p in registry]
    lost = marked.where("parser_id is null").select("*", F.lit(0).alias("ordinal"), F.lit("no parser found").alias("error"))
    return reduce(DataFrame.unionByName, parts, _finished(lost, _carried(marked)))


def raise_errors(parsed: DataFrame) -> None:
    row = parsed.where("error is not null").select("error").first()
    if row is not None:
        raise ParseError(row["error"])
