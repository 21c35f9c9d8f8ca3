"""Queries of what is stored and changed: appended tables, cases, holds, audit, exports by name, streams, fixed test vectors.

Each builds its own tables in a new folder of the shared store from the whole forensic view, by the same calls that a `Workspace` makes.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.errors import PayloadTooLargeError, ValidationError
from casebook.functions import ed25519
from casebook.functions import text as T
from casebook.functions.hashing import blake3
from casebook.operators import audit, entities, export, graph, holds
from casebook.operators.cases import Cases
from casebook.operators.holds import Holds
from casebook.plans import registry as R
from casebook.plans.adapter import full_events
from casebook.plans.registry import ev, on_view, query
from casebook.plans.storage import shared_dir
from casebook.plans.session import table
from casebook.schema import ENTITY_TYPES, SEARCH_BYTES
from casebook.sources import files, parsers
from casebook.streaming import ingest, online, slots
from casebook.workspace import Workspace

DAY = datetime(2025, 3, 1)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


# ---- appended tables -----------------------------------------------------------------------------


@query(on_view("select sha256(body) as content_hash, strlen(body) as byte_size, 'gate' as source_id, body, '2025-03-01' as received_date from raw", R._RAW_SQL))
def raw_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    payloads = R._raw(spark, sf_dir).select("content", F.decode("content", "UTF-8").alias("payload"), "content_type")
    files.write_raw(files.raw_events(payloads, F.lit(DAY), "gate"), path)
    return spark.read.parquet(path).select("content_hash", "byte_size", "source_id", F.decode("content", "UTF-8").alias("body"), F.col("received_date").cast("string").alias("received_date"))


@query(on_view(f"select {R.SHOWN_SQL}, src_ip, array_to_string(tags, ',') as tags, strftime(occurred_at, '%Y-%m-%d') as occurred_date from ev"))
def events_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    files.write_events(full_events(ev(spark, sf_dir)), path)
    return spark.read.parquet(path).select(*R.SHOWN, "src_ip", F.array_join("tags", ",").alias("tags"), F.col("occurred_date").cast("string").alias("occurred_date"))


@query(on_view("select max(n) as max_bytes, 'accepted' as outcome from (select strlen(body) as n from raw) union all select max(n) - 1, 'refused' from (select strlen(body) as n from raw)", R._RAW_SQL))
def payload_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = R._raw(spark, sf_dir)
    most, rows = raw.agg(F.max("byte_size")).first()[0], []
    for limit in (most, most - 1):
        try:
            files.require_sizes(raw, limit)
            rows.append((limit, "accepted"))
        except PayloadTooLargeError:
            rows.append((limit, "refused"))
    return spark.createDataFrame(rows, "max_bytes int, outcome string")


_DAYS_SQL = "days as (select date_trunc('day', occurred_at) as d, count(*) as n from ev group by 1)"


@query(on_view("""select cast(d as timestamp) as occurred_at, 'ingest' as action, 'source' as resource_type, strftime(d, '%Y-%m-%d') as resource_id, '{"n": ' || n || '}' as detail from days order by occurred_at desc limit 50""", _DAYS_SQL))
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    days = ev(spark, sf_dir).groupBy(F.date_trunc("day", "occurred_at").cast("timestamp_ntz").alias("d")).agg(F.count("*").alias("n")).collect()
    audit.append(spark, path, [(r["d"], "ingest", "gate", "source", f"{r['d']:%Y-%m-%d}", f'{{"n": {r["n"]}}}') for r in days])
    audit.append(spark, path, [(datetime(2024, 1, 5), "login", "gate", "user", "x", "{}")])
    return audit.query(spark.read.parquet(path), action="ingest", actor="gate").select("occurred_at", "action", "resource_type", "resource_id", "detail")


# ---- syslog without a format, and whole payloads that fail ----------------------------------------


@query(on_view("""select event_id, 'syslog.unknown' as event_type, case when event_id % 8 <= 2 then 4 when event_id % 8 = 3 then 3 when event_id % 8 = 4 then 2 when event_id % 8 <= 6 then 1 else 0 end as severity,
    cast(null as varchar) as hostname, timestamp '2030-01-01' as occurred_at, '{"message":"saw ' || event_type || ' twice","priority":' || event_id % 192 || '}' as custom_fields from ev"""))
def parse_syslog_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">saw "), "event_type", F.lit(" twice"))
    parsed = parsers.parse_syslog(ev(spark, sf_dir).select("event_id", line.alias("payload")), now=R._now())
    return parsed.select("event_id", "event_type", "severity", "hostname", "occurred_at", "custom_fields")


@query(on_view("select raw_event_id, case when raw_event_id % 3 = 0 then 1 else count(*) end as n_rows, case when raw_event_id % 3 = 0 then 1 else 0 end as n_errors from ev group by raw_event_id"))
def parse_syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines a payload with blank ones between; where one line has no priority the payload fails whole."""
    bad = (F.col("raw_event_id") % 3 == 0) & (F.col("event_id") == F.col("first"))
    rows = ev(spark, sf_dir).select("raw_event_id", "event_id")
    first = rows.groupBy("raw_event_id").agg(F.min("event_id").alias("first"))
    line = F.when(bad, "no priority").otherwise(F.concat(F.lit("<134>line "), F.col("event_id").cast("string")))
    payloads = rows.join(first, "raw_event_id").groupBy("raw_event_id").agg(F.array_join(F.collect_list(line), "\n \r\n").alias("payload"))
    return parsers.parse_syslog(payloads, now=R._now()).groupBy("raw_event_id").agg(F.count("*").alias("n_rows"), F.count("error").alias("n_errors"))


# ---- cases ---------------------------------------------------------------------------------------

_HEADS_SQL = "heads as (select case_id as name, 'gate' as created_by, min(occurred_at) as created_at, count(*) as n from ce join ev using (event_id) group by case_id)"


def _cases(spark: SparkSession, sf_dir: str) -> tuple[Cases, dict[str, str]]:
    """A case for each of the view's cases, created at its first event; (cases, id of each name)."""
    made = Cases(spark, _folder(spark))
    heads = export.attach(R._case_events(spark, sf_dir), ev(spark, sf_dir)).groupBy("case_id").agg(F.min("occurred_at").alias("at"), F.count("*").alias("n")).orderBy("case_id").collect()
    return made, {r["case_id"]: made.create(r["case_id"], "gate", r["at"], f"{r['n']} events") for r in heads}


_HEAD = ("name", "description", "status", "created_by", "created_at", "updated_at")


@query(on_view("select name, n || ' events' as description, 'open' as status, created_by, created_at, created_at as updated_at from heads", R._CASE_SQL, _HEADS_SQL))
def case_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, ids = _cases(spark, sf_dir)
    out = made.cases.read().limit(0)
    for case_id in ids.values():
        out = out.unionByName(made.get(case_id))
    return out.select(*_HEAD)


@query(on_view("select name, created_at, updated_at from (select *, created_at as updated_at from heads) order by updated_at desc, name limit 3", R._CASE_SQL, _HEADS_SQL))
def case_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _cases(spark, sf_dir)
    return made.listed("open", 3).select("name", "created_at", "updated_at")


@query(on_view("""select case when name = 'case-1' then 'renamed' else name end as name, case when name = 'case-1' then 'closed' else 'open' end as status, created_at,
    case when name = 'case-1' then timestamp '2025-03-01' else created_at end as updated_at from heads""", R._CASE_SQL, _HEADS_SQL))
def case_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, ids = _cases(spark, sf_dir)
    if "case-1" in ids:
        made.patch(ids["case-1"], DAY, name="renamed", status="closed")
    return made.cases.read().select("name", "status", "created_at", "updated_at")


def _attached(spark: SparkSession, sf_dir: str) -> tuple[Cases, DataFrame]:
    made = Cases(spark, _folder(spark))
    wanted = R._case_events(spark, sf_dir).withColumn("added_by", F.lit("gate"))
    made.attach_all(wanted.where("event_id % 2 = 0"))
    made.attach_all(wanted)  # what is attached already stays as it is
    return made, wanted


_ATTACHED_SQL = "case_id, event_id, pinned, annotation, added_at"


@query(on_view(f"select {_ATTACHED_SQL}, 'gate' as added_by from ce", R._CASE_SQL))
def case_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attached(spark, sf_dir)[0].attached.read().select("case_id", "event_id", "pinned", "annotation", "added_at", "added_by")


@query(on_view("select case_id, event_id from ce where event_id <> (select min(event_id) from ce)", R._CASE_SQL))
def case_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, wanted = _attached(spark, sf_dir)
    first = wanted.orderBy("event_id").first()
    made.detach(first["case_id"], first["event_id"])
    return made.attached.read().select("case_id", "event_id")


@query(on_view("select case_id, event_id, pinned or event_id = (select min(event_id) from ce) as pinned, case when event_id = (select min(event_id) from ce) then 'see \"this\"' else annotation end as annotation from ce", R._CASE_SQL))
def case_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, wanted = _attached(spark, sf_dir)
    first = wanted.orderBy("event_id").first()
    made.mark(first["case_id"], first["event_id"], pinned=True, annotation='see "this"')
    return made.attached.read().select("case_id", "event_id", "pinned", "annotation")


_LINES_SQL = f"""lines as (select case_id, n, 'csv' as form, event_type || ',' || {R._ISO_SQL} || ',' || {R._QUOTE_SQL.format('actor_id')} || ',' || source_id || ',' || {R._LABEL_SQL} || ',' || {R._QUOTE_SQL.format('annotation')} as line from placed
    union all select case_id, n, 'markdown', '| ' || n || ' | ' || event_type || ' | ' || {R._ISO_SQL} || ' | ' || replace(actor_id, '|', '\\|') || ' | ' || source_id || ' | ' || {R._LABEL_SQL} || ' | ' || case when pinned then 'Yes' else 'No' end || ' | '
        || replace(coalesce(nullif(annotation, ''), '-'), '|', '\\|') || ' |' from placed)"""
_PLACED_SQL = f"placed as (select *, {R._PLACE_SQL} from ce join ev using (event_id))"


@query(on_view("select 'CSV' as asked, * from lines where form = 'csv' union all select asked, lines.* from lines, (values ('markdown'), ('md')) as t(asked) where form = 'markdown' union all select 'xml', null, null, 'refused', null", R._CASE_SQL, _PLACED_SQL, _LINES_SQL))
def export_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached = export.attach(R._case_events(spark, sf_dir), ev(spark, sf_dir))
    out = spark.createDataFrame([], "asked string, case_id string, n int, form string, line string")
    for asked in ("CSV", "markdown", "md", "xml"):
        try:
            form = export.format_named(asked)
            lines = {"csv": export.csv_lines, "markdown": export.markdown_lines}[form](attached)
            out = out.unionByName(lines.select(F.lit(asked).alias("asked"), "case_id", "n", F.lit(form).alias("form"), "line"))
        except ValidationError:
            out = out.unionByName(spark.createDataFrame([(asked, None, None, "refused", None)], out.schema))
    return out


# ---- holds ---------------------------------------------------------------------------------------


def _held(spark: SparkSession, sf_dir: str) -> tuple[Workspace, dict[str, str]]:
    """A workspace of all events with three holds that are created and materialised: of a week, of a device, of a query. Names and ids of the holds."""
    w = Workspace(spark, _folder(spark))
    files.write_events(full_events(ev(spark, sf_dir)), f"{w.path}/events")
    kinds = (("week", "time_range", {"start": R.START.isoformat(), "end": R.END.isoformat()}), ("box", "entity", {"entity_type": "device", "identifier": "dev-7"}), ("grave", "query", {"min_severity": 3}))
    made = {name: w.holds.create(name, kind, criteria, "gate", DAY + timedelta(hours=h)) for h, (name, kind, criteria) in enumerate(kinds)}
    for hold in made.values():
        w.materialise(hold)
    return w, made


_HELD_SQL = f"""held as (select 'week' as name, event_id from ev where {R.WINDOW.replace(' < ', ' <= ')} union all select distinct 'box', event_id from seen where entity_type = 'device' and identifier = 'dev-7'
    union all select 'grave', event_id from ev where severity >= 3)"""


@query(on_view("""select name, hold_type, 'active' as status, created_at, count(event_id) as n_events from held join (values ('week', 'time_range', timestamp '2025-03-01 00:00:00'), ('box', 'entity', timestamp '2025-03-01 01:00:00'),
    ('grave', 'query', timestamp '2025-03-01 02:00:00')) t(name, hold_type, created_at) using (name) group by all""", R._SEEN_SQL, _HELD_SQL))
def hold_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds from their creation to the events they hold."""
    w, _ = _held(spark, sf_dir)
    return w.holds.listed("active").join(holds.counts(w.hold_events()), "hold_id").select("name", "hold_type", "status", "created_at", "n_events")


@query(on_view("select event_id, occurred_at, severity from ev where event_id in (select event_id from held where name <> 'grave')", R._SEEN_SQL, _HELD_SQL))
def hold_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still held once one of the holds is released."""
    w, made = _held(spark, sf_dir)
    w.holds.release(made["grave"], datetime(2025, 3, 2))
    return holds.held_events(w.events(), w.hold_events(), w.holds.holds.read()).select("event_id", "occurred_at", "severity")


@query(on_view(f"select 'week' as hold_id, event_id from ev where {R.WINDOW.replace(' < ', ' <= ')} and event_id % 3 <> 0"))
def hold_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = holds.of_time_range(ev(spark, sf_dir), R.START, R.END)
    held = wanted.where("event_id % 3 = 0").select(F.lit("week").alias("hold_id"), "event_id").union(wanted.select(F.lit("other"), "event_id"))
    return holds.missing("week", wanted, held)


@query(on_view(f"select count(*) as added, 0 as added_again from ev where {R.WINDOW.replace(' < ', ' <= ')}"))
def hold_rows_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, _folder(spark))
    files.write_events(full_events(ev(spark, sf_dir)), f"{w.path}/events")
    hold = w.holds.create("week", "time_range", {"start": R.START.isoformat(), "end": R.END.isoformat()}, "gate", DAY)
    return spark.createDataFrame([(w.materialise(hold), w.materialise(hold))], "added long, added_again int")


# ---- allow-lists, search text, capped chains ------------------------------------------------------


@query(on_view("select 'user' as asked, count(*) as n from ents where entity_type = 'user' union all select 'ip', count(*) from ents where entity_type = 'ip' union all select 'device', count(*) from ents where entity_type = 'device' union all select 'planet', -1", R._SEEN_SQL, R._ENTITIES_SQL))
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.entities(R._seen(spark, sf_dir))
    out = spark.createDataFrame([], "asked string, n long")
    for asked in ("user", "ip", "device", "planet"):
        try:
            out = out.union(entities.listed(found, asked, None).agg(F.lit(asked), F.count("*")))
        except ValidationError:
            assert asked not in ENTITY_TYPES
            out = out.union(spark.createDataFrame([(asked, -1)], out.schema))
    return out


@query("""with trimmed as (select doc_id, regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g') as t from documents),
    sized as (select doc_id, t, max(k) as n from trimmed, range(0, 501) r(k) where strlen(left(t, cast(k as bigint))) <= 500 group by all)
    select doc_id, left(t, cast(n as bigint)) as cleaned from sized""")
def search_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a search query: trimmed, and cut to the limit of bytes at a character."""
    return table(spark, sf_dir, "documents").select("doc_id", T.search_text_of("text", SEARCH_BYTES).alias("cleaned"))


def _met_sql(level: int, before: str) -> str:
    return f"""m{level} as (select s.event_id, s.occurred_at, row_number() over (partition by c.event_id, entity_type, identifier order by s.occurred_at, s.event_id) as n
        from c{level - 1} c join seen o using (event_id) join seen s using (entity_type, identifier) where s.occurred_at >= c.occurred_at - interval 180 minute and s.occurred_at < c.occurred_at + interval 180 minute),
    c{level} as (select distinct event_id, occurred_at from m{level} where n <= 3 and event_id not in ({before}))"""


@query(on_view(
    "select * from (select *, 0 as depth from c0 union all select *, 1 from c1 union all select *, 2 from c2) order by depth, occurred_at, event_id limit 12", R._SEEN_SQL,
    "c0 as (select event_id, occurred_at from ev where event_id = 500)", _met_sql(1, "select event_id from c0"), _met_sql(2, "select event_id from c0 union all select event_id from c1"),
))
def corr_chain_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chain(ev(spark, sf_dir), 500, depth=2, window_seconds=21_600, per_entity=3, limit=12)


# ---- streams -------------------------------------------------------------------------------------


@query(on_view("""select 'syslog.' || split_part(event_type, '.', 1) as event_type, case when event_id % 8 <= 2 then 4 when event_id % 8 = 3 then 3 when event_id % 8 = 4 then 2 when event_id % 8 <= 6 then 1 else 0 end as severity,
    occurred_at, nullif(hostname, '') as hostname, '{"app_name":"' || split_part(event_type, '.', 1) || '","message":"event ' || event_id || '","priority":' || event_id % 192 || '}' as custom_fields from ev"""))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded run over files of syslog lines."""
    path = _folder(spark)
    host = F.coalesce(F.nullif("hostname", F.lit("")), F.lit("-"))
    line = F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">1 "), R._iso(), F.lit(" "), host, F.lit(" "), F.split_part("event_type", F.lit("."), F.lit(1)), F.lit(" 77 - event "), F.col("event_id").cast("string"))
    ev(spark, sf_dir).select(line.alias("value")).write.text(f"{path}/in")
    ingest.ingest(ingest.payload_stream(spark, f"{path}/in/*.txt"), f"{path}/out", f"{path}/state", now=R._now).awaitTermination()
    return spark.read.parquet(f"{path}/out/events").select("event_type", "severity", "occurred_at", "hostname", "custom_fields")


@query(R._sequence_sql(R._longer(R.EXFIL, R.WEEK)))
def stream_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online detection over a bounded stream gives what the batch operator gives."""
    path = _folder(spark)
    ev(spark, sf_dir).select("event_id", "event_type", "occurred_at", "actor_id").write.parquet(f"{path}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    found = online.detect(rows, R._longer(R.EXFIL, R.WEEK))
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(online.OUT).parquet(f"{path}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


def _stream_of(spark: SparkSession, events: DataFrame, path: str) -> DataFrame:
    """The events as a stream of five files: thirds of their time, and two later events that close what waits for the watermark."""
    lo, hi = events.agg(F.min("occurred_at"), F.max("occurred_at")).first()
    third = F.when(F.col("occurred_at") < lo + (hi - lo) / 3, 0).when(F.col("occurred_at") < lo + (hi - lo) * 2 / 3, 1).otherwise(2)
    for k in range(3):
        events.where(third == k).coalesce(1).write.mode("append").parquet(path)
    for days in (30, 31):
        last = {c: F.lit(None).cast(t) for c, t in events.dtypes} | {"event_id": F.lit(-days).cast("long"), "event_type": F.lit("stream.closed"), "occurred_at": F.lit(hi + timedelta(days=days)).cast("timestamp_ntz")}
        if "actor_id" in last:
            last["actor_id"] = F.lit("closing")
        spark.range(1).select(*(last[c].alias(c) for c in events.columns)).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(R._sequence_sql(R.DEPLOY))
def stream_deploys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern over all actors, online: state by time slot."""
    path = _folder(spark)
    rows = _stream_of(spark, ev(spark, sf_dir).select("event_id", "event_type", "occurred_at", "actor_id"), f"{path}/in")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", slots.PROVIDER)
    try:
        slots.collect(slots.candidates(rows, R.DEPLOY), f"{path}/out", f"{path}/state").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return R._flat(slots.matches(spark, f"{path}/out", R.DEPLOY))


_SESSIONS_SQL = """timed as (select trim(actor_id) as actor_id, occurred_at, event_id, lag(occurred_at) over (partition by trim(actor_id) order by occurred_at, event_id) as before from ev where trim(actor_id) <> ''),
    marked as (select *, sum(case when before is null or occurred_at - before > interval 6 hour then 1 else 0 end) over (partition by actor_id order by occurred_at, event_id) as n from timed)"""


@query(on_view("select actor_id, min(occurred_at) as started_at, max(occurred_at) as ended_at, count(*) as n_events from marked group by actor_id, n", _SESSIONS_SQL))
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows by actor over a bounded stream."""
    path = _folder(spark)
    rows = _stream_of(spark, ev(spark, sf_dir).select("event_id", "event_type", "occurred_at", "actor_id"), f"{path}/in")
    found = ingest.sessions(rows, "6 hours")
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").where("actor_id <> 'closing'")


@query(on_view("""select distinct r.event_id as from_id, s.event_id, s.entity_type, s.identifier from ev r join seen o on o.event_id = r.event_id join seen s using (entity_type, identifier)
    where r.event_type = 'deploy.release' and s.event_id <> r.event_id and s.occurred_at >= r.occurred_at - interval 600 second and s.occurred_at < r.occurred_at + interval 600 second""", R._SEEN_SQL))
def stream_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shares an entity with a release within ten minutes before and after it, by a join of two streams."""
    path = _folder(spark)
    rows = _stream_of(spark, ev(spark, sf_dir).select("event_id", "event_type", "occurred_at", "actor_id", "actor_name", "src_ip", "dst_ip", "device_id", "hostname"), f"{path}/in")
    found = ingest.linked(rows, rows.where("event_type = 'deploy.release' or event_type = 'stream.closed'"), 1200)
    # a join keeps four state stores a partition and writes each in every batch, so there are as many partitions as the cluster runs tasks
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    try:
        found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    return spark.read.schema(found.schema).parquet(f"{path}/out").where("from_id >= 0 and event_id >= 0")


# ---- fixed values: published test vectors --------------------------------------------------------


@query("""select * from (values ('', 'af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262'), ('abc', '6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85'),
    ('hello world', 'd74981efa70a0c880b8d8c1985d075dbcbf679b99a5f9914e5aaf96b831a9e24')) t(content, hash_hex)""")
def blake3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("",), ("abc",), ("hello world",)], "content string")
    return rows.select("content", blake3(F.encode("content", "UTF-8")).alias("hash_hex"))


@query("""select * from (values (1, 'd75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a',
        'e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b', true, false),
    (2, '3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c',
        '92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00', true, false)) t(k, public_key, signature, verified, other_verified)""")
def ed25519_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    rows = []
    for k, (seed, message) in enumerate(zip(map(bytes.fromhex, seeds), (b"", b"\x72"), strict=True), 1):
        key, signature = ed25519.public_key(seed), ed25519.sign(seed, message)
        rows.append((k, key.hex(), signature.hex(), ed25519.verify(key, message, signature), ed25519.verify(key, message + b"x", signature)))
    return spark.createDataFrame(rows, "k int, public_key string, signature string, verified boolean, other_verified boolean")
