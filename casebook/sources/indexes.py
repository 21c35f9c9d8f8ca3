"""The stored tables that lookups answer from, kept up to date batch by batch.

    indexes = Indexes("/data/indexes")
    indexes.update(events, batch=0)          # or as `Indexes.stream(...)`, or in `streaming.ingest`
    search.indexed_page(indexes.postings, events, "login failed")

One update writes a batch of each table: posting lists by lexeme, keys by value, and the mergeable aggregates of entities and of relationships, the latter from
both ends. Nothing that was written is read or changed by an update, so it costs what the batch costs, and an update that is run again replaces its own rows.
Entities and relationships are merged when they are read, without a shuffle of the stored rows, since parts of one entity share a bucket; `compact` merges old batches for good.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casebook.operators import entities, keys, search
from casebook.sources.stored import StoredTable

TABLES = ("postings", "keys", "entities", "adjacency")
SPREAD = 16  # tasks that write one bucket, where a key may have very many rows


@dataclass(frozen=True)
class Indexes:
    path: str
    buckets: int = 64
    version: int = 0  # of the compacted tables

    def _table(self, name: str, columns: str, key: str, *order: str, spread: str = "") -> StoredTable:
        return StoredTable(f"{self.path}/{name}/v{self.version}", columns, key, order, self.buckets, spread)

    @property
    def postings(self) -> StoredTable:
        return self._table("postings", "lexeme string, slot long, parts int, part int, n long, ids array<struct<at: timestamp_ntz, id: long>>", "lexeme", "slot", "part", spread=f"pmod(slot, {SPREAD})")

    @property
    def keys(self) -> StoredTable:
        return self._table("keys", "key_value string, key_type string, event_id long, occurred_at timestamp_ntz, ord int", "key_value", "key_type", "occurred_at", spread=f"pmod(xxhash64(event_id), {SPREAD})")

    @property
    def entities(self) -> StoredTable:
        aggregates = "latest struct<event_id: long, display_name: string>, arrived struct<event_id: long, occurred_at: timestamp_ntz>, first_seen timestamp_ntz, last_seen timestamp_ntz, event_count long"
        return self._table("entities", f"identifier string, entity_type string, {aggregates}", "identifier", "entity_type")

    @property
    def adjacency(self) -> StoredTable:
        columns = "end string, end_type string, other_type string, other string, relationship string, outgoing boolean, first_seen timestamp_ntz, last_seen timestamp_ntz, event_count long, sample_event_id long"
        return self._table("adjacency", columns, "end", "end_type", "other", spread=f"pmod(xxhash64(other), {SPREAD})")

    def update(self, events: DataFrame, batch: int, with_hints: bool = False, tables: Sequence[str] = TABLES) -> None:
        """Makes ``events`` what the tables (or some of them) hold of a batch."""
        rows = {
            "postings": lambda: search.posting_lists(events),
            "keys": lambda: keys.key_table(events, with_hints),
            "entities": lambda: entities.partial_entities(entities.observations(events)),
            "adjacency": lambda: entities.partial_adjacency(entities.relation_observations(events)),
        }
        for name in tables:
            getattr(self, name).write(rows[name](), batch)

    def rebuilt(self, spark: SparkSession, events: DataFrame) -> Indexes:
        """New tables that hold ``events`` alone."""
        new = Indexes(self.path, self.buckets, self.version + 1)
        new.update(events, 0, with_hints=True)
        return new

    def stream(self, events: DataFrame, checkpoint: str, trigger: dict | None = None, tables: Sequence[str] = TABLES) -> StreamingQuery:
        """Keeps the tables (or some of them) up to date with a stream of events; the stream's batch numbers are the tables'."""
        writer = events.writeStream.foreachBatch(lambda df, number: self.update(df, number, tables=tables)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def entity_table(self, spark: SparkSession, first_by_ingest: bool = False) -> DataFrame:
        return entities.merged_entities(self.entities.read(spark), first_by_ingest)

    def relationships(self, spark: SparkSession) -> DataFrame:
        return entities.merged_relationships(self.adjacency.read(spark).where("outgoing"))

    def entity(self, spark: SparkSession, entity_type: str, identifier: str) -> DataFrame:
        """One entity, from its bucket."""
        return entities.merged_entities(self.entities.of(spark, [identifier]).where(F.col("entity_type") == entity_type))

    def relationships_of(self, spark: SparkSession, entity_type: str, identifier: str, limit: int | None = 500) -> DataFrame:
        """Relationships of one entity in both directions, from its bucket."""
        rows = self.adjacency.of(spark, [identifier]).where(F.col("end_type") == entity_type)
        return entities.relationships_of(entities.merged_relationships(rows), entity_type, identifier, limit)

    def compact(self, spark: SparkSession, upto: int, tables: Sequence[str] = TABLES) -> Indexes:
        """New tables in which the batches up to ``upto`` are one, with one row an entity and an edge; the old ones stay for their readers."""
        new = Indexes(self.path, self.buckets, self.version + 1)
        old = lambda table: table.read(spark).where(F.col("batch") <= upto)
        merged = {
            "entities": lambda: old(self.entities).groupBy("entity_type", "identifier").agg(
                F.max("latest").alias("latest"), F.min("arrived").alias("arrived"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count")
            ),
            "adjacency": lambda: old(self.adjacency).groupBy("end_type", "end", "other_type", "other", "relationship", "outgoing").agg(
                F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count"), F.max("sample_event_id").alias("sample_event_id")
            ),
        }
        for name in tables:
            getattr(self, name).compact(spark, getattr(new, name).path, upto, merged[name]() if name in merged else None)
        return new
