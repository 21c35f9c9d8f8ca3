"""The entity graph: neighbourhoods within a few steps, and correlation chains of events.

Both are frontier loops: each level joins the newly reached vertices (never those already
reached) with edges that run in both directions, so the join is an equi-join. Levels are written
out once, as their lineage would otherwise be run again by every later level.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebook.errors import ValidationError
from casebook.operators.entities import merged_relationships, observations
from casebook.operators.timeline import in_window
from casebook.plans.storage import cut
from casebook.schema import CHAIN_DEPTH, CHAIN_WINDOW_SECONDS
from casebook.sources.stored import MAX_LITERALS, StoredTable


def _from(edges: DataFrame, frontier: DataFrame, side: str, other: str) -> DataFrame:
    """The ends at ``other`` of the edges whose ``side`` is in the frontier."""
    at = frontier.select(F.col("entity_type").alias(f"{side}_type"), F.col("identifier").alias(side))
    return edges.join(at, [f"{side}_type", side], "left_semi").select(F.col(f"{other}_type").alias("entity_type"), F.col(other).alias("identifier"))


def neighbourhood(edges: DataFrame, entity_type: str, identifier: str, depth: int = 1) -> DataFrame:
    """entity_type, identifier, depth of all entities within ``depth`` steps, the centre not included.

    The first level filters the edges by the centre, which reaches their scan; later levels meet them by the frontier
    alone. Nothing is written but the levels, so edges that are derived and not stored are best written once before.
    """
    if not 1 <= depth <= CHAIN_DEPTH:
        raise ValidationError(f"depth must be between 1 and {CHAIN_DEPTH}")
    reached = frontier = edges.sparkSession.createDataFrame([(entity_type, identifier, 0)], "entity_type string, identifier string, depth int")
    ends = (("source", "target"), ("target", "source"))
    for level in range(1, depth + 1):
        near = []
        for side, other in ends:
            centre = (F.col(f"{side}_type") == entity_type) & (F.col(side) == identifier)
            near.append(edges.where(centre).select(F.col(f"{other}_type").alias("entity_type"), F.col(other).alias("identifier")) if level == 1 else _from(edges, frontier, side, other))
        frontier = cut(near[0].union(near[1]).distinct().join(reached, ["entity_type", "identifier"], "left_anti").withColumn("depth", F.lit(level)))
        reached = reached.unionByName(frontier)
    return reached.where("depth > 0")


def induced_edges(edges: DataFrame, entity_type: str, identifier: str, depth: int = 1) -> DataFrame:
    """The edges whose ends are both in the neighbourhood or its centre."""
    near = neighbourhood(edges, entity_type, identifier, depth).select("entity_type", "identifier")
    inside = cut(near.union(edges.sparkSession.createDataFrame([(entity_type, identifier)], near.schema)))
    for side in ("source", "target"):
        ends = inside.withColumnsRenamed({"entity_type": f"{side}_type", "identifier": side})
        edges = edges.join(ends, [f"{side}_type", side], "left_semi")
    return edges


def _ends(adjacency: StoredTable, frontier: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Adjacency rows of a frontier: only its buckets are read where it is small enough for a filter, else it is joined, and the adjacency is not shuffled. ``known``: its identifiers, if they are at hand."""
    spark = frontier.sparkSession
    some = known or [r["identifier"] for r in frontier.select("identifier").limit(MAX_LITERALS + 1).collect()]
    rows = adjacency.of(spark, sorted(set(some))) if len(some) <= MAX_LITERALS else adjacency.read(spark)
    return rows.join(frontier.select(F.col("entity_type").alias("end_type"), F.col("identifier").alias("end")), ["end_type", "end"], "left_semi")


def stored_neighbourhood(adjacency: StoredTable, spark: SparkSession, entity_type: str, identifier: str, depth: int = 1) -> DataFrame:
    """`neighbourhood` on a stored adjacency: each level reads the frontier's buckets, and no edge is aggregated."""
    if not 1 <= depth <= CHAIN_DEPTH:
        raise ValidationError(f"depth must be between 1 and {CHAIN_DEPTH}")
    reached = frontier = spark.createDataFrame([(entity_type, identifier, 0)], "entity_type string, identifier string, depth int")
    for level in range(1, depth + 1):
        rows = adjacency.of(spark, [identifier]).where(F.col("end_type") == entity_type) if level == 1 else _ends(adjacency, frontier)
        near = rows.select(F.col("other_type").alias("entity_type"), F.col("other").alias("identifier")).distinct()
        frontier = near.join(reached, ["entity_type", "identifier"], "left_anti").withColumn("depth", F.lit(level))
        if level < depth:  # the last level is read once
            frontier = cut(frontier)
        reached = reached.unionByName(frontier)
    return reached.where("depth > 0")


def stored_edges(adjacency: StoredTable, spark: SparkSession, entity_type: str, identifier: str, depth: int = 1) -> DataFrame:
    """`induced_edges` on a stored adjacency: only rows of the neighbourhood are merged to relationships."""
    near = stored_neighbourhood(adjacency, spark, entity_type, identifier, depth).select("entity_type", "identifier")
    inside = cut(near.union(spark.createDataFrame([(entity_type, identifier)], near.schema)))
    rows = _ends(adjacency, inside).where("outgoing").join(inside.withColumnsRenamed({"entity_type": "other_type", "identifier": "other"}), ["other_type", "other"], "left_semi")
    return merged_relationships(rows)


def chain(events: DataFrame, seed_id: object, depth: int = 1, window_seconds: int = 3600, per_entity: int | None = None, limit: int | None = None) -> DataFrame:
    """event_id, occurred_at, depth of the events a seed leads to through shared entities.

    At each level an event's entities lead to their events within half the window before and
    after that event; events already reached stay out. The seed has depth 0. For interactive use
    ``per_entity`` keeps only the earliest of these for each event and entity, and of more than
    ``limit`` events the nearest levels stay, earliest first (`CHAIN_PER_ENTITY`, `CHAIN_EVENTS`).
    """
    if not 1 <= depth <= CHAIN_DEPTH:
        raise ValidationError(f"depth must be between 1 and {CHAIN_DEPTH}")
    if not 1 <= window_seconds <= CHAIN_WINDOW_SECONDS:
        raise ValidationError(f"the window must be between 1 and {CHAIN_WINDOW_SECONDS} seconds")
    around = timedelta(seconds=window_seconds / 2)
    half = F.lit(around)
    reached = frontier = cut(events.where(F.col("event_id") == seed_id).select("event_id", "occurred_at", F.lit(0).alias("depth")))
    for level in range(1, depth + 1):
        first, last = frontier.agg(F.min("occurred_at"), F.max("occurred_at")).first()
        if first is None:
            break
        # no level looks further than this, so only the days around its events are read
        near = in_window(events, first - around, last + around)
        seen = observations(near).select("event_id", "occurred_at", "entity_type", "identifier")
        probes = frontier.select(F.col("event_id").alias("from_id"), F.col("occurred_at").alias("at")).join(seen.select(F.col("event_id").alias("from_id"), "entity_type", "identifier"), "from_id")
        # buckets of half the window: an event's partners lie in its own bucket or one beside it, so a hot entity meets only what is near in time
        slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / int(around.total_seconds() * 1_000_000))
        near_slots = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: slot("at") + k)).alias("slot")
        probes = probes.select("*", near_slots)
        met = seen.withColumn("slot", slot("occurred_at")).join(probes, ["entity_type", "identifier", "slot"]).where((F.col("occurred_at") >= F.col("at") - half) & (F.col("occurred_at") < F.col("at") + half))
        if per_entity is not None:
            earliest = W.partitionBy("from_id", "entity_type", "identifier").orderBy("occurred_at", "event_id")
            met = met.withColumn("n", F.row_number().over(earliest)).where(F.col("n") <= per_entity)
        frontier = cut(met.select("event_id", "occurred_at").distinct().join(reached, "event_id", "left_anti").withColumn("depth", F.lit(level)))
        reached = reached.unionByName(frontier)
    return reached if limit is None else reached.orderBy("depth", "occurred_at", "event_id").limit(limit)


def chain_entities(events: DataFrame, links: DataFrame) -> DataFrame:
    """entity_type, identifier, first_at of the entities in a chain's events."""
    return observations(events).join(links.select("event_id"), "event_id", "left_semi").groupBy("entity_type", "identifier").agg(F.min("occurred_at").alias("first_at"))
