"""The event model: column lists, enums and limits."""

from __future__ import annotations

# The flat event table. Nested views are built from it when asked for (operators.normalize.nested).
EVENT_COLUMNS = {
    "event_id": "long", "raw_event_id": "long", "event_type": "string", "severity": "int",
    "occurred_at": "timestamp_ntz", "observed_at": "timestamp_ntz", "received_at": "timestamp_ntz",
    "actor_id": "string", "actor_name": "string", "actor_type": "string",
    "subject_id": "string", "subject_name": "string", "subject_type": "string",
    "object_id": "string", "object_name": "string", "object_type": "string",
    "src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "string",
    "device_id": "string", "device_name": "string", "device_type": "string", "hostname": "string",
    "source_id": "string", "source_type": "string", "source_name": "string",
    "tags": "array<string>", "custom_fields": "string",
}

SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")
ENTITY_TYPES = ("user", "device", "ip", "host", "session", "service")
RELATIONSHIPS = ("from_ip", "used_device", "hosted_on", "accessed", "owns", "member_of", "communicated_with")
HOLD_TYPES = ("time_range", "case", "entity", "query")
CASE_STATUSES = ("open", "closed", "exported", "archived")

TIMELINE_LIMIT, TIMELINE_MAX = 100, 1000
SEARCH_LIMIT, SEARCH_MAX, SEARCH_OFFSET_MAX, SEARCH_BYTES = 20, 100, 10_000, 500
CHAIN_DEPTH, CHAIN_EVENTS, CHAIN_PER_ENTITY, CHAIN_WINDOW_SECONDS = 3, 500, 100, 86_400
HOLD_EVENTS, BUNDLE_EVENTS, REPLAY_MAX_DELAY_MS, FUTURE_SECONDS = 10_000, 500, 5000, 60
