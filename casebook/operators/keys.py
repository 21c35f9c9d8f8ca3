"""Correlation keys: what ties events together, and lookups through them.

An event's keys, in order: identity (actor_id), ip (src, then dst), device, host, session
(``session_id``, ``session``) and token (``token``, ``access_token``) from the custom fields, where only JSON
strings count. Values are trimmed, blanks dropped, and of equal (type, value) the first stays.
Keys are a derived table: it is exploded from the events, never updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebook.functions.text import present
from casebook.operators import timeline
from casebook.sources.stored import StoredTable

LABELS = {"identity": "identity", "session": "session", "token": "token", "ip": "IP address", "device": "device", "host": "hostname"}
KEY = "struct<key_type:string,key_value:string>"


def json_string(document: Column, name: str) -> Column:
    """A top-level field of a variant if it is a string, else null (numbers and booleans are no keys)."""
    at = F.try_variant_get(document, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(document, f"$.{name}", "string"))


def event_keys(document: Column | None = None) -> Column:
    """array<struct<key_type, key_value>> of an event, in order; ``document``: the custom fields, parsed."""
    document = F.try_parse_json("custom_fields") if document is None else document
    parts = [
        ("identity", F.col("actor_id")), ("ip", F.col("src_ip")), ("ip", F.col("dst_ip")), ("device", F.col("device_id")), ("host", F.col("hostname")),
        *(("session", json_string(document, n)) for n in ("session_id", "session")),
        *(("token", json_string(document, n)) for n in ("token", "access_token")),
    ]
    made = F.array(*(F.struct(F.lit(kind).alias("key_type"), present(value).alias("key_value")) for kind, value in parts))
    return F.array_distinct(F.filter(made, lambda k: k["key_value"].isNotNull()))


def hint_keys() -> Column:
    """What a JSON parser hints at: actor, source address, device and host as they are, untrimmed, not deduplicated."""
    parts = [("identity", "actor_id"), ("ip", "src_ip"), ("device", "device_id"), ("host", "hostname")]
    made = F.array(*(F.struct(F.lit(kind).alias("key_type"), F.col(c).alias("key_value")) for kind, c in parts))
    return F.filter(made, lambda k: k["key_value"].isNotNull() & (k["key_value"] != ""))


def key_table(events: DataFrame, with_hints: bool = False) -> DataFrame:
    """event_id, occurred_at, ord, key_type, key_value; hints that the extracted keys lack come after them."""
    events = events.withColumn("_document", F.try_parse_json("custom_fields"))  # parsed once for all fields
    keys = event_keys(F.col("_document"))
    if with_hints:
        keys = F.concat(keys, F.filter(F.array_except(hint_keys(), keys), lambda k: k.isNotNull()))
    return events.select("event_id", "occurred_at", F.posexplode(keys).alias("ord", "key")).select("event_id", "occurred_at", "ord", "key.*")


def lookup(keys: DataFrame, events: DataFrame, key_type: str, key_value: str, limit: int | None = 50) -> DataFrame:
    """Events with a key, newest first; all of them if ``limit`` is None."""
    hit = keys.where((F.col("key_type") == key_type) & (F.col("key_value") == key_value)).select("event_id", "occurred_at").distinct()
    out = events.join(hit, ["event_id", "occurred_at"])
    return out if limit is None else out.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(limit)


def stored_lookup(table: StoredTable, events: DataFrame, key_type: str, key_value: str, limit: int = 50) -> DataFrame:
    """`lookup` on a stored key table: one bucket gives the newest ids, and only these events are read."""
    hit = table.of(events.sparkSession, [key_value]).where(F.col("key_type") == key_type).select("event_id", "occurred_at").distinct()
    return timeline.picked(events, hit.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(limit))


def stored_related(table: StoredTable, events: DataFrame, event_id: object, limit: int = 50, exact: bool = False) -> DataFrame:
    """`related` on a stored key table: the event's own keys come from the event, and only their buckets are read."""
    own = key_table(events.where(F.col("event_id") == event_id), with_hints=True).select(F.col("ord").alias("probe"), "key_type", "key_value")
    rows = own.collect()
    return related(table.of(events.sparkSession, sorted({r["key_value"] for r in rows})), events, event_id, limit, exact, events.sparkSession.createDataFrame(rows, own.schema))


def related(keys: DataFrame, events: DataFrame, event_id: object, limit: int = 50, exact: bool = False, own: DataFrame | None = None) -> DataFrame:
    """Events that share a key with ``event_id``: event_id, occurred_at, ord (the first key that led there).

    ``exact`` takes at most ``limit`` rows of each key before the event itself and repeats are dropped; else
    the limit applies to the different events found. ``own``: the event's keys (probe, key_type, key_value), if they are known.
    """
    if own is None:
        own = keys.where(F.col("event_id") == event_id).select(F.col("ord").alias("probe"), "key_type", "key_value")
        own = keys.sparkSession.createDataFrame(own.collect(), own.schema)  # one event's keys: a local table of known size, so the planner broadcasts it if it may
    met = keys.select("event_id", "occurred_at", "key_type", "key_value").join(own, ["key_type", "key_value"])
    if exact:
        newest = W.partitionBy("probe").orderBy(F.desc("occurred_at"), F.desc("event_id"))
        met = met.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit)
    first = met.where(F.col("event_id") != event_id).groupBy("event_id", "occurred_at").agg(F.min("probe").alias("ord"))
    return first.orderBy("ord", F.desc("occurred_at"), F.desc("event_id")).limit(limit)


def key_groups(keys: DataFrame) -> DataFrame:
    """For each key its events: n_events, first_at, last_at. The pairs within a key need not be listed to know them.

    Here and in `degrees` an event has a key once, as in a key table without hints.
    """
    return keys.groupBy("key_type", "key_value").agg(F.count("*").alias("n_events"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def degrees(keys: DataFrame) -> DataFrame:
    """event_id, key_type, key_value, n_related: how many other events share each key of each event."""
    sizes = keys.groupBy("key_type", "key_value").agg(F.count("*").alias("n"))
    return keys.select("event_id", "key_type", "key_value").join(sizes, ["key_type", "key_value"]).select("event_id", "key_type", "key_value", (F.col("n") - 1).alias("n_related"))


def describe(keys: Column) -> Column:
    """The kinds of an event's keys in words, each once, in order."""
    named = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    label = lambda k: F.coalesce(F.try_element_at(named, k["key_type"]), F.concat(F.lit("custom("), k["key_type"], F.lit(")")))
    text = F.array_join(F.array_distinct(F.transform(keys, label)), ", ")
    return F.when(F.size(keys) == 0, "no correlation keys").otherwise(F.concat(F.lit("correlated by: "), text))
