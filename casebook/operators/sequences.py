"""Ordered sequence detection under time bounds.

A match takes the earliest event for each step in turn; the gap to the previous step is bounded
(not for the first step), as is the total. Matches of one partition do not overlap: after a match the
search goes on behind its last event. ``same_actor`` patterns look at each trimmed actor by itself.

As window functions: rows that match no step are dropped. Time is cut into slots as long as
the total bound, so whatever starts in a slot ends in it or the next one; each row goes to
its own slot and, as look-ahead, to the one before. Partitions are (actor, slot), so neither an actor with
very many events nor a pattern over all actors makes one long partition. With the rows in reverse order,
``last(..., ignorenulls)`` over the preceding rows gives for each row the chain of earliest later events for
the remaining steps: one streaming pass for each step over one shuffle and sort. Complete chains
within the bounds are candidates.

Candidates overlap only within stretches of slots that touch; summaries of slots tell where
a stretch starts. Of a stretch those candidates are kept that start behind the last one kept: a fold where a stretch has at most ``FOLD_LIMIT`` candidates,
pointer jumping where it has more, with the same result.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebook.errors import ValidationError
from casebook.functions.text import globbed, present
from casebook.plans.storage import cut

FOLD_LIMIT = 4096  # candidates that a task folds at once
LINK = "struct<ts:timestamp_ntz,id:{0}>"


@dataclass(frozen=True)
class Step:
    event_type_pattern: str
    max_gap_secs: int | None = None


@dataclass(frozen=True)
class Pattern:
    name: str
    steps: tuple[Step, ...]
    max_total_duration_secs: int
    same_actor: bool = True
    description: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Pattern:
        try:
            d = json.loads(text)
            steps = tuple(Step(s["event_type_pattern"], s.get("max_gap_secs")) for s in d["steps"])
            return Pattern(d["name"], steps, int(d["max_total_duration_secs"]), bool(d.get("same_actor", True)), d.get("description", ""))
        except (ValueError, KeyError, TypeError) as e:
            raise ValidationError(f"not a sequence pattern: {e}") from e


# The built-in patterns.
BUILT_IN = (
    Pattern("data_exfiltration", (Step("auth.login*"), Step("*.access"), Step("data.export")), 3600, True, "A login, an access and an export by one actor"),
    Pattern("brute_force_success", (Step("auth.login_failed"), Step("auth.login_failed"), Step("auth.login")), 600, True, "Failed logins before a successful one"),
    Pattern("bad_deploy", (Step("deploy.*"), Step("error.*"), Step("error.*")), 1800, False, "Errors after a deployment"),
)


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _slot_of(ts: Column, bound: int) -> Column:
    return F.floor(_micros(ts) / F.lit(bound)).cast("long")


def _stretches(found: DataFrame) -> DataFrame:
    """Adds to candidates (actor_id, slot, start, end) their ``part``, the number of candidates in it, and its first start: candidates of two parts do not overlap."""
    slots = found.groupBy("actor_id", "slot").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n"))
    order = W.partitionBy("actor_id").orderBy("slot")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = slots.withColumn("new", F.coalesce((F.col("lo") > before).cast("long"), F.lit(1))).withColumn("part", F.sum("new").over(order))
    of = W.partitionBy("actor_id", "part")
    return found.join(starts.select("actor_id", "slot", "part", F.sum("n").over(of).alias("n_part"), F.min("lo").over(of).alias("root")), ["actor_id", "slot"])


def _folded(found: DataFrame, id_type: str) -> DataFrame:
    """actor_id, c of the candidates that stay, of parts that one task can hold: a fold in order of their starts."""

    def keep(state: Column, c: Column) -> Column:
        free = (F.size(state) == 0) | (F.element_at(F.element_at(state, -1), -1) < c[0])
        return F.when(free, F.concat(state, F.array(c))).otherwise(state)

    empty = F.array().cast("array<array<" + LINK.format(id_type) + ">>")
    kept = found.groupBy("actor_id", "part").agg(F.aggregate(F.array_sort(F.collect_list("chain")), empty, keep).alias("kept"))
    return kept.select("actor_id", F.explode("kept").alias("c"))


def _followed(found: DataFrame, bound: int) -> DataFrame:
    """actor_id, start, next: the first candidate of the part behind each candidate's end.

    Slots of a part follow each other without a gap, so what is next starts in the slot of the end or is the first of the slot after it: no window is longer than a slot.
    """
    ends = found.select("actor_id", "part", _slot_of(F.col("end.ts"), bound).alias("slot"), F.col("end").alias("at"), F.lit(False).alias("opens"), "start")
    starts = found.select("actor_id", "part", "slot", F.col("start").alias("at"), F.lit(True).alias("opens"), "start")
    firsts = found.groupBy("actor_id", "part", (F.col("slot") - 1).alias("slot")).agg(F.min("start").alias("at")).select("*", F.lit(True).alias("opens"), F.col("at").alias("start"))
    later = W.partitionBy("actor_id", "part", "slot").orderBy(F.desc("at"), "opens").rowsBetween(W.unboundedPreceding, -1)
    marks = ends.unionByName(starts).unionByName(firsts).withColumn("next", F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(later))
    return marks.where("not opens").select("actor_id", "start", "next")


def _jumped(found: DataFrame, bound: int) -> DataFrame:
    """`_folded` for parts of any size, by pointer jumping.

    Each candidate points to the next one it would leave free. What can be reached from a part's first candidate stays. Each round doubles how far pointers lead, so a part of n
    candidates takes log n rounds of equi-joins over many tasks.
    """
    jumps = cut(_followed(found, bound).where("next is not null"))
    reached = cut(found.where(F.col("start") == F.col("root")).select("actor_id", "start"))
    rounds = [reached]
    while True:
        step = cut(reached.join(jumps, ["actor_id", "start"]).select("actor_id", F.col("next").alias("start")))
        if step.isEmpty():
            break
        rounds.append(step)
        reached = reduce(DataFrame.unionByName, rounds)
        onward = jumps.select("actor_id", F.col("start").alias("next"), F.col("next").alias("onward"))
        jumps = cut(jumps.join(onward, ["actor_id", "next"]).select("actor_id", "start", F.col("onward").alias("next")))
    return found.join(reached, ["actor_id", "start"], "left_semi").select("actor_id", F.col("chain").alias("c"))


def chosen(candidates: DataFrame, pattern: Pattern, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """The matches among candidates (actor_id, '' over all actors; slot; chain): in order of their starts, each that starts behind the end of the last one."""
    bound = max(1, pattern.max_total_duration_secs * 1_000_000)
    id_type = candidates.schema["chain"].dataType.elementType["id"].dataType.simpleString()
    named = candidates.select("actor_id", "slot", "chain", F.col("chain")[0].alias("start"), F.element_at("chain", -1).alias("end"))
    sizes = Observation()
    found = cut(_stretches(named).observe(sizes, F.max("n_part").alias("most")))
    kept = _folded(found.where(F.col("n_part") <= fold_limit), id_type)
    if (sizes.get["most"] or 0) > fold_limit:
        kept = kept.unionByName(_jumped(found.where(F.col("n_part") > fold_limit), bound))
    return kept.select(
        F.lit(pattern.name).alias("pattern"), F.nullif("actor_id", F.lit("")).alias("actor_id"), F.col("c")[0]["ts"].alias("started_at"),
        F.element_at("c", -1)["ts"].alias("ended_at"), F.transform("c", lambda x: x["id"]).alias("event_ids"),
    )


def relevant(events: DataFrame, pattern: Pattern, timed: str | None = None) -> DataFrame:
    """ts, id, actor_id ('' over all actors), own slot and whether each step takes the event (m0, m1, ...), of events that any step takes.

    ``timed``, of a stream, is the column with the watermark. It is kept, and takes part in the filter, which the optimizer then leaves behind the watermark: so all events move it on, not only those that a step takes.
    """
    flags = [globbed("event_type", s.event_type_pattern).alias(f"m{k}") for k, s in enumerate(pattern.steps)]
    actor = present("actor_id") if pattern.same_actor else F.lit("")  # no actor is blank, so the blank is free
    takes = reduce(Column.__or__, (globbed("event_type", s.event_type_pattern) for s in pattern.steps)) & actor.isNotNull()
    rows = events.where(takes if timed is None else F.when(takes, F.col(timed)).isNotNull())
    rows = rows.select(F.col("occurred_at").alias("ts"), F.col("event_id").alias("id"), actor.alias("actor_id"), *flags, *([timed] if timed else []))
    return rows.withColumn("_own", _slot_of(F.col("ts"), max(1, pattern.max_total_duration_secs * 1_000_000)))


def candidates(events: DataFrame, pattern: Pattern) -> DataFrame:
    """actor_id, slot, chain (array of ts and id) of every event that starts a chain within the bounds."""
    bound = pattern.max_total_duration_secs * 1_000_000
    rows = relevant(events, pattern).withColumn("slot", F.explode(F.array("_own", F.col("_own") - 1)))
    later = W.partitionBy("actor_id", "slot").orderBy(F.desc("ts"), F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    link = F.array(F.struct("ts", "id"))
    last = len(pattern.steps) - 1
    rows = rows.withColumn(f"c{last}", F.when(F.col(f"m{last}"), link))
    for k in range(last - 1, -1, -1):
        rest = F.last(f"c{k + 1}", ignorenulls=True).over(later)
        rows = rows.withColumn(f"n{k}", rest).withColumn(f"c{k}", F.when(F.col(f"m{k}") & F.col(f"n{k}").isNotNull(), F.concat(link, F.col(f"n{k}"))))
    apart = lambda a, b: _micros(b["ts"]) - _micros(a["ts"])
    at = lambda k: F.element_at("c0", k + 1)
    within = [apart(at(0), at(last)) <= bound]
    within += [apart(at(k - 1), at(k)) <= s.max_gap_secs * 1_000_000 for k, s in enumerate(pattern.steps) if k and s.max_gap_secs is not None]
    return rows.where((F.col("slot") == F.col("_own")) & F.col("c0").isNotNull()).where(reduce(Column.__and__, within)).select("actor_id", "slot", F.col("c0").alias("chain"))


def detect(events: DataFrame, pattern: Pattern, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """pattern, actor_id (null over all actors), started_at, ended_at, event_ids of the matches."""
    if not pattern.steps:
        shape = f"pattern string, actor_id string, started_at timestamp_ntz, ended_at timestamp_ntz, event_ids array<{dict(events.dtypes)['event_id']}>"
        return events.sparkSession.createDataFrame([], shape)
    return chosen(candidates(events, pattern), pattern, fold_limit)


def scan(events: DataFrame, stored: list[str] = (), max_events: int | None = None) -> DataFrame:
    """Matches of all built-in and stored patterns; stored definitions that cannot be read are skipped."""
    patterns = list(BUILT_IN)
    for text in stored:
        try:
            patterns.append(Pattern.from_json(text))
        except ValidationError:
            continue
    if max_events is not None:
        events = events.orderBy("occurred_at", "event_id").limit(max_events)
    return reduce(DataFrame.unionByName, (detect(events, p) for p in patterns))


def new_detections(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Detections not stored yet, by pattern and events; scanning twice adds nothing."""
    return found.dropDuplicates(["pattern", "event_ids"]).join(stored.select("pattern", "event_ids"), ["pattern", "event_ids"], "left_anti")


def summary(events: DataFrame, found: DataFrame, n_patterns: int = len(BUILT_IN)) -> DataFrame:
    counts = events.agg(F.count("*").alias("events_scanned"), F.lit(n_patterns).cast("long").alias("patterns_checked"))
    return counts.join(F.broadcast(found.agg(F.count("*").alias("sequences_detected"))))


def with_detections(patterns: DataFrame, found: DataFrame) -> DataFrame:
    """The pattern table with the number of each pattern's detections, and the first and last time of them."""
    stats = found.groupBy(F.col("pattern").alias("name")).agg(F.count("*").alias("n_detections"), F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"))
    return patterns.join(stats, "name", "left").withColumn("n_detections", F.coalesce("n_detections", F.lit(0)))


def pattern_table(spark: SparkSession, patterns: tuple[Pattern, ...] = BUILT_IN) -> DataFrame:
    rows = [(p.name, p.description, len(p.steps), p.max_total_duration_secs, p.same_actor, p.to_json()) for p in patterns]
    return spark.createDataFrame(rows, "name string, description string, n_steps int, max_total_duration_secs int, same_actor boolean, definition string")
