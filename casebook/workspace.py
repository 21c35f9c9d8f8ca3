"""One object over a folder of tables: ingest, queries, investigations.

    w = Workspace(spark, "/data/case-data")
    w.ingest([b'{"event_type": ...}'], "application/json", source_id="idp")
    w.timeline(Filters(min_severity=3))

Events and raw payloads are append-only tables partitioned by date. Entities, relationships, keys and search are derived from
the events when asked for, or, with ``indexed=True``, answered from stored indexes that each ingest adds a batch to (`index` makes them for events that are there already).
Every change is noted in the audit trail.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.errors import NotFoundError, ValidationError
from casebook.operators import audit, bundle, entities, export, graph, holds, keys, normalize, replay, search, sequences, timeline
from casebook.operators.cases import Cases
from casebook.operators.holds import Holds
from casebook.operators.timeline import Filters
from casebook.plans.state import StateTable
from casebook.plans.storage import cut
from casebook.schema import EVENT_COLUMNS
from casebook.sources import files, parsers
from casebook.sources.indexes import Indexes

RAW = {
    "raw_event_id": "long", "content": "binary", "content_hash": "string", "content_type": "string", "byte_size": "int", "parser_id": "string",
    "source_id": "string", "source_type": "string", "source_name": "string", "received_at": "timestamp_ntz", "received_date": "date",
}
STORED = EVENT_COLUMNS | {"lexemes": "array<string>", "occurred_date": "date"}
DETECTED = "pattern string, actor_id string, started_at timestamp_ntz, ended_at timestamp_ntz, event_ids array<long>"
PATTERN = "name string, definition string, enabled boolean"
HELD = "hold_id string, event_id long"


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Workspace:
    def __init__(self, spark: SparkSession, path: str, actor: str = "system", indexed: bool = False):
        self.spark, self.path, self.actor, self.indexed = spark, path, actor, indexed
        self.indexes = Indexes(f"{path}/indexes", buckets=16)
        self.cases, self.holds = Cases(spark, f"{path}/state"), Holds(spark, f"{path}/state")
        self.stored_patterns = StateTable(spark, f"{path}/state/patterns", PATTERN)

    def _table(self, name: str, schema: str) -> DataFrame:
        """An appended table; empty before the first append."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _noted(self, action: str, kind: str, resource: object, **detail: object) -> None:
        audit.append(self.spark, f"{self.path}/audit", [(_now(), action, self.actor, kind, str(resource), json.dumps(detail, default=str, sort_keys=True))])

    # ---- tables

    def events(self) -> DataFrame:
        return self._table("events", _ddl(STORED))

    def raw(self) -> DataFrame:
        return self._table("raw", _ddl(RAW))

    def keys(self) -> DataFrame:
        return keys.key_table(self.events(), with_hints=True)

    def observations(self) -> DataFrame:
        return entities.observations(self.events())

    def index(self) -> None:
        """Makes the stored indexes of all events, as one batch in the place of all others."""
        self.indexes = self.indexes.rebuilt(self.spark, self.events())
        self.indexed = True
        self._noted("index", "events", self.indexes.version)

    def entity_table(self) -> DataFrame:
        if self.indexed:
            return self.indexes.entity_table(self.spark)
        return entities.entities(self.observations())

    def relationships(self) -> DataFrame:
        if self.indexed:
            return self.indexes.relationships(self.spark)
        return entities.relationships(entities.relation_observations(self.events()))

    # ---- ingest

    def ingest(self, payloads: list[bytes], content_type: str, source_id: str = "api", source_type: str = "direct", source_name: str | None = None, parser_id: str | None = None) -> DataFrame:
        """Parse and store payloads; one bad payload or event fails all. Returns the new events."""
        rows = self.spark.createDataFrame([(bytearray(p), content_type) for p in payloads], "content binary, content_type string")
        return self.ingest_frame(rows.withColumn("payload", F.decode("content", "UTF-8")), source_id, source_type, source_name, parser_id)

    def ingest_frame(self, payloads: DataFrame, source_id: str = "api", source_type: str = "direct", source_name: str | None = None, parser_id: str | None = None) -> DataFrame:
        """The same for a DataFrame with ``payload`` and ``content_type``, such as `sources.files.read_payloads` gives."""
        now = F.lit(_now()).cast("timestamp_ntz")
        raw = cut(files.raw_events(payloads, now, source_id, source_type, source_name).withColumn("parser_id", F.lit(parser_id).cast("string") if parser_id else parsers.detected(F.col("payload"), F.col("content_type"))))
        files.require_sizes(raw)
        parsed = parsers.parse(raw.select("raw_event_id", "payload", "content_type"), parser_id, now=now)
        parsers.raise_errors(parsed)
        good, bad = normalize.normalized(parsed, now, source_id, source_type, source_name)
        normalize.require_none(bad)
        good = cut(good)
        files.write_raw(raw.select(*(c for c in RAW if c != "received_date")), f"{self.path}/raw")
        files.write_events(good, f"{self.path}/events")
        if self.indexed:
            self.indexes.update(good, time.time_ns(), with_hints=True)
        self._noted("ingest", "source", source_id, content_type=parser_id)
        return good

    # ---- events

    def timeline(self, by: Filters = Filters(), limit: int = 100, cursor: str | None = None, newest_first: bool = True) -> tuple[list, str | None]:
        return timeline.fetch_page(self.events(), by, limit, cursor, newest_first)

    def event(self, event_id: int) -> object:
        return timeline.fetch_event(self.events(), event_id)

    def event_raw(self, event_id: int) -> object:
        row = normalize.raw_view(timeline.event_by_id(self.events(), event_id), self.raw()).first()
        if row is None:
            raise NotFoundError(f"event {event_id} not found")
        return row

    def correlated(self, event_id: int, limit: int = 50) -> DataFrame:
        self.event(event_id)
        if self.indexed:
            return keys.stored_related(self.indexes.keys, self.events(), event_id, limit)
        return keys.related(self.keys(), self.events(), event_id, limit)

    def search(self, query: str, limit: int = 0, offset: int = 0) -> tuple[int, list]:
        found = self.events()
        if self.indexed:
            return search.indexed_total(self.indexes.postings, self.spark, query).first()["total"], search.indexed_page(self.indexes.postings, found, query, limit, offset).collect()
        return search.total(found, query).first()["total"], search.page(found, query, limit, offset).collect()

    def replay(self, start: datetime, end: datetime, speed: float = 1.0, source_id: str | None = None, entity: tuple[str, str] | None = None) -> Iterator[tuple]:
        chosen = None if entity is None else (self.observations(), *entity)
        return replay.frames(self.events(), speed, start=start, end=end, source_id=source_id, entity=chosen)

    # ---- entities, chains, sequences

    def entity(self, entity_type: str, identifier: str) -> tuple[object, list]:
        row = (self.indexes.entity(self.spark, entity_type, identifier) if self.indexed else entities.one(self.entity_table(), entity_type, identifier)).first()
        if row is None:
            raise NotFoundError(f"entity {entity_type} {identifier!r} not found")
        if self.indexed:
            return row, self.indexes.relationships_of(self.spark, entity_type, identifier).collect()
        return row, entities.relationships_of(self.relationships(), entity_type, identifier).collect()

    def list_entities(self, entity_type: str | None = None, limit: int = 50) -> DataFrame:
        return entities.listed(self.entity_table(), entity_type, limit)

    def search_entities(self, text: str, entity_type: str | None = None, limit: int = 50) -> DataFrame:
        return entities.searched(self.entity_table(), text, entity_type, limit)

    def entity_timeline(self, entity_type: str, identifier: str, start: datetime | None = None, end: datetime | None = None, limit: int = 100) -> DataFrame:
        return entities.timeline(self.observations(), self.events(), entity_type, identifier, start, end, limit)

    def entity_graph(self, entity_type: str, identifier: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        if self.indexed:
            asked = (self.indexes.adjacency, self.spark, entity_type, identifier, depth)
            return graph.stored_neighbourhood(*asked), graph.stored_edges(*asked)
        edges = cut(self.relationships())
        return graph.neighbourhood(edges, entity_type, identifier, depth), graph.induced_edges(edges, entity_type, identifier, depth)

    def chain(self, event_id: int, depth: int = 1, window_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
        self.event(event_id)
        found = cut(graph.chain(self.events(), event_id, depth, window_seconds))
        return found, graph.chain_entities(self.events(), found)

    def add_pattern(self, pattern: sequences.Pattern, enabled: bool = True) -> None:
        names = {p.name for p in sequences.BUILT_IN} | {r["name"] for r in self.stored_patterns.read().select("name").collect()}
        if pattern.name in names or not pattern.steps:
            raise ValidationError(f"pattern {pattern.name!r} exists or has no steps")
        self.stored_patterns.append([(pattern.name, pattern.to_json(), enabled)])
        self._noted("create", "pattern", pattern.name)

    def patterns(self) -> list[sequences.Pattern]:
        stored = [r["definition"] for r in self.stored_patterns.read().where("enabled").orderBy("name").collect()]
        return [*sequences.BUILT_IN, *map(sequences.Pattern.from_json, stored)]

    def scan_sequences(self, start: datetime | None = None, end: datetime | None = None) -> int:
        """Runs all patterns over the window; the number of detections that are new."""
        stored = [r["definition"] for r in self.stored_patterns.read().where("enabled").collect()]
        found = sequences.scan(timeline.in_window(self.events(), start, end), stored)
        new = cut(sequences.new_detections(found, self.detected_sequences(None)))
        new.write.mode("append").parquet(f"{self.path}/detections")
        self._noted("scan", "sequences", new.count())
        return new.count()

    def detected_sequences(self, limit: int | None = 100, offset: int = 0) -> DataFrame:
        found = self._table("detections", DETECTED)
        return found if limit is None else found.orderBy(F.desc("started_at"), "pattern", "event_ids").offset(offset).limit(limit)

    # ---- cases, bundles, holds

    def _case_head(self, case_id: str) -> export.CaseHead:
        c = self.cases.get(case_id).first()
        return export.CaseHead(case_id, c.name, c.created_by, c.created_at.isoformat() + "+00:00", c.description, c.status)

    def export_case(self, case_id: str, form: str = "json") -> str:
        head = self._case_head(case_id)
        text = export.render(head, export.attach(self.cases.events(case_id, None), self.events().drop("lexemes", "occurred_date")), form, _now().isoformat() + "+00:00")
        self._noted("export", "case", case_id, format=form)
        return text

    def bundle_case(self, case_id: str, seed: bytes) -> dict:
        head = self._case_head(case_id)
        made = bundle.build(case_id, head.name, self.cases.events(case_id, None), self.events().drop("lexemes", "occurred_date"), self.raw(), seed, _now().isoformat() + "+00:00")
        self._noted("bundle", "case", case_id, root=made["chain"]["root_hash"])
        return made

    def hold_events(self) -> DataFrame:
        return self._table("hold_events", HELD)

    def materialise(self, hold_id: str) -> int:
        """Adds the events that a hold's criteria name and it lacks; how many they were."""
        hold = self.holds.get(hold_id).first()
        if hold.status != "active":
            raise ValidationError("only an active hold can be materialised")
        c = json.loads(hold.criteria)
        at = lambda name: datetime.fromisoformat(c[name])
        try:
            wanted = {
                "time_range": lambda: holds.of_time_range(self.events(), at("start"), at("end")),
                "case": lambda: holds.of_case(self.cases.events(c["case_id"], None), self.events()),
                "entity": lambda: holds.of_entity(self.observations(), c["entity_type"], c["identifier"]),
                "query": lambda: holds.of_query(self.events(), Filters(**c)),
            }[hold.hold_type]()
        except (KeyError, TypeError, ValueError) as e:
            raise ValidationError(f"criteria of hold {hold_id}: {e}") from e
        new = cut(holds.missing(hold_id, wanted, self.hold_events()))
        new.write.mode("append").parquet(f"{self.path}/hold_events")
        self._noted("materialise", "hold", hold_id)
        return new.count()

    def is_held(self, event_id: int) -> bool:
        return holds.held_events(timeline.event_by_id(self.events(), event_id), self.hold_events(), self.holds.holds.read()).first() is not None

    def audit(self, action: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return audit.query(self._table("audit", f"{audit.AUDIT}, occurred_date date"), action=action, limit=limit, offset=offset)
