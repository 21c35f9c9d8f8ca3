import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casebook.errors import NotFoundError, ValidationError
from casebook.functions import ed25519, hashing, text
from casebook.operators import bundle, cases, entities, export, graph, holds, keys, normalize, replay, search, sequences, timeline
from casebook.operators.sequences import BUILT_IN, Pattern, Step
from casebook.operators.timeline import Filters
from casebook.sources.indexes import Indexes
from casebook.sources.stored import StoredTable
from tests.plain import blake3_plain, greedy

T0 = datetime(2026, 1, 1)
EVENT = "event_id long, raw_event_id long, event_type string, severity int, occurred_at timestamp_ntz, actor_id string, actor_name string, src_ip string, dst_ip string, device_id string, hostname string, source_id string, tags array<string>, custom_fields string"


def events(spark, *rows):
    base = dict(raw_event_id=1, event_type="a.b", severity=0, actor_id=None, actor_name=None, src_ip=None, dst_ip=None, device_id=None, hostname=None, source_id="s", tags=[], custom_fields="{}")
    made = [base | {"event_id": k, "occurred_at": T0 + timedelta(seconds=k)} | r for k, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in EVENT.split(", ")) for r in made], EVENT)


def test_keys_of_full_event(spark):
    df = events(spark, dict(actor_id=" u ", src_ip="1.1.1.1", dst_ip="1.1.1.1", device_id="d", hostname=" ", custom_fields='{"session_id":"s","session":"s","token":5,"access_token":"t"}'))
    got = [(r.key_type, r.key_value) for r in keys.key_table(df).orderBy("ord").collect()]
    assert got == [("identity", "u"), ("ip", "1.1.1.1"), ("device", "d"), ("session", "s"), ("token", "t")]
    hinted = {(r.key_type, r.key_value) for r in keys.key_table(df, with_hints=True).collect()}
    assert ("identity", " u ") in hinted and ("host", " ") in hinted
    assert df.select(keys.describe(keys.event_keys())).first()[0] == "correlated by: identity, IP address, device, session, token"
    assert events(spark, {}).select(keys.describe(keys.event_keys())).first()[0] == "no correlation keys"


def test_entities_and_relationships(spark):
    df = events(spark, dict(actor_id="u", actor_name=" ", src_ip="1.1.1.1", dst_ip="1.1.1.1", device_id="d", hostname="h"), dict(src_ip="1.1.1.1", device_id="d"), dict(actor_name="only a name"))
    seen = entities.observations(df)
    assert {(r.entity_type, r.role) for r in seen.where("event_id = 1").collect()} == {("user", "actor"), ("ip", "src_ip"), ("device", "device"), ("host", "host")}
    rel = entities.relation_observations(df).groupBy("event_id").count().collect()
    assert {(r.event_id, r["count"]) for r in rel} == {(1, 4), (2, 1)}
    found = entities.entities(seen)
    assert entities.one(found, "ip", "1.1.1.1").first().event_count == 2 and entities.one(found, "user", "u").first().display_name is None
    with pytest.raises(ValidationError):
        entities.listed(found, "planet")


def test_graph_and_chain(spark):
    df = events(spark, dict(actor_id="a", src_ip="1.1.1.1"), dict(actor_id="b", src_ip="1.1.1.1"), dict(actor_id="b", device_id="d"), dict(actor_id="z"))
    edges = entities.relationships(entities.relation_observations(df))
    got = {(r.identifier, r.depth) for r in graph.neighbourhood(edges, "user", "a", 3).collect()}
    assert got == {("1.1.1.1", 1), ("b", 2), ("d", 3)}
    assert graph.induced_edges(edges, "user", "a", 1).count() == 1
    assert {(r.event_id, r.depth) for r in graph.chain(df, 1, 2, 60).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert graph.chain(df, 99, 1, 60).count() == 0
    for bad in (0, 4):
        with pytest.raises(ValidationError):
            graph.neighbourhood(edges, "user", "a", bad)


@pytest.mark.parametrize("same_actor", [True, False])
def test_sequences_match_the_greedy_search(spark, same_actor):
    rng = random.Random(3)
    for trial in range(4):
        rows = [dict(event_type=rng.choice(["x", "y", "z", "w"]), actor_id=rng.choice(["a", " a ", "b", " ", None]), occurred_at=T0 + timedelta(seconds=rng.randint(0, 300))) for _ in range(150)]
        df = events(spark, *rows)
        p = Pattern("p", tuple(Step(rng.choice(["x", "y", "z*", "*"]), rng.choice([None, 5, 40])) for _ in range(rng.randint(1, 4))), rng.choice([0, 10, 60, 1000]), same_actor)
        ordered = sorted(((r["occurred_at"], k, r["event_type"], (r["actor_id"] or "").strip()) for k, r in enumerate(rows, 1)))
        groups = sorted({x[3] for x in ordered} - {""}) if same_actor else [None]
        expected = sorted(m for g in groups for m in greedy([x[:3] for x in ordered if g is None or x[3] == g], p))
        for limit in (4096, 3):  # by folds, and by pointer jumping
            assert sorted(r.event_ids for r in sequences.detect(df, p, limit).collect()) == expected, (trial, p, limit)


def test_one_long_stretch(spark):
    """Every event starts a candidate that overlaps the next ones, over many slots: pointers are followed in log rounds."""
    rng = random.Random(4)
    rows = [dict(event_type=rng.choice("xy"), occurred_at=T0 + timedelta(seconds=k * 3 + rng.randint(0, 2))) for k in range(1500)]
    p = Pattern("p", (Step("*"), Step("x"), Step("y")), 60, False)
    ordered = sorted((r["occurred_at"], k, r["event_type"]) for k, r in enumerate(rows, 1))
    found = sequences.detect(events(spark, *rows), p, 10)
    expected = greedy(ordered, p)
    assert sorted(r.event_ids for r in found.collect()) == sorted(expected) and len(expected) > 200
    stretch = sequences._stretches(sequences.candidates(events(spark, *rows), p).select("actor_id", "slot", "chain", F.col("chain")[0].alias("start"), F.element_at("chain", -1).alias("end")))
    assert stretch.agg(F.max("n_part")).first()[0] > 1000


def test_sequence_details(spark):
    df = events(spark, dict(event_type="auth.login", actor_id="u"), dict(event_type="file.access", actor_id="u"), dict(event_type="data.export", actor_id="u"))
    found = sequences.scan(df, ["{bad json"])
    assert [(r.pattern, r.event_ids) for r in found.collect()] == [("data_exfiltration", [1, 2, 3])]
    assert sequences.new_detections(found, found).count() == 0
    assert sequences.detect(df, Pattern("none", (), 5)).count() == 0
    assert all(Pattern.from_json(p.to_json()) == p for p in BUILT_IN)
    assert text.glob_matches("auth.login*", "auth.login_failed") and text.glob_matches("*", "") and not text.glob_matches("", "x")


def test_timeline(spark):
    df = events(spark, *({} for _ in range(5)))
    rows, cursor = timeline.fetch_page(df, limit=2)
    assert [r.event_id for r in rows] == [1, 2] and timeline.decode_cursor(cursor) == (rows[-1].occurred_at.replace(tzinfo=timeline.UTC), "2")
    rest, last = timeline.fetch_page(df, limit=3, cursor=cursor)
    assert [r.event_id for r in rest] == [3, 4, 5] and last is None
    for bad in (0, 1001):
        with pytest.raises(ValidationError):
            timeline.page(df, limit=bad)
    for bad in ("%%%", timeline.base64.urlsafe_b64encode(b"nocomma").decode()):
        with pytest.raises(ValidationError):
            timeline.decode_cursor(bad)
    with pytest.raises(ValidationError):
        timeline.filtered(df, Filters(start=T0, end=T0))
    with pytest.raises(NotFoundError):
        timeline.fetch_event(df, 99)


def test_pruning_and_pushdown(spark, tmp_path):
    from casebook.sources.files import write_events

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = str(tmp_path / "events")
    write_events(events(spark, {}, dict(occurred_at=T0 + timedelta(days=3))), path)
    plan = timeline.filtered(spark.read.parquet(path), Filters(start=T0, end=T0 + timedelta(days=1), source_id="s")).select("event_id")
    text_plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(occurred_date" in text_plan and "EqualTo(source_id,s)" in text_plan
    assert plan.count() == 1


def test_search(spark):
    df = events(spark, dict(actor_name="Ann Lee"), dict(event_type="ann.lee"))
    assert [r.event_id for r in search.page(df, "LEE ann").collect()] == [1]
    with pytest.raises(ValidationError):
        search.page(df, "  ")
    with pytest.raises(ValidationError):
        search.page(df, "x", offset=10_001)
    assert text.search_text("é" * 300, 500) == "é" * 250


def test_replay(spark):
    df = events(spark, dict(occurred_at=T0), dict(occurred_at=T0 + timedelta(seconds=1)), dict(occurred_at=T0 + timedelta(days=2)))
    assert [r.delay_ms for r in replay.schedule(df, 2.0).orderBy("occurred_at").collect()] == [0, 500, 5000]
    waits = []
    got = list(replay.frames(df, 0, waits.append))
    assert [g[0] for g in got] == ["event"] * 3 + ["done"] and got[-1][2] == '{"total":3}' and not waits
    seen = entities.observations(events(spark, dict(actor_id="u"), {}))
    assert replay.schedule(events(spark, dict(actor_id="u"), {}), entity=(seen, "user", "u")).count() == 1
    with pytest.raises(ValidationError):
        replay.schedule(df, -1)


def test_normalized(spark):
    df = events(spark, dict(src_ip="010.0.0.1"), dict(src_ip="nowhere"), dict(occurred_at=T0 + timedelta(days=9))).drop("event_id").withColumn("ordinal", F.lit(0))
    good, bad = normalize.normalized(df, F.lit(T0 + timedelta(days=1)).cast("timestamp_ntz"))
    assert [r.src_ip for r in good.collect()] == ["10.0.0.1"] and bad.count() == 2
    with pytest.raises(ValidationError):
        normalize.require_none(bad)
    parts = normalize.nested(good).first()
    assert parts.actor is None and parts.network.src_ip == "10.0.0.1"


def test_hashes(spark):
    # known answers of the published specifications
    assert hashing.blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 4096, 5121, 7 * 1024, 31 * 1024 + 5, 100_000]
    items = [bytes((i * 7 + n) % 251 for i in range(n)) for n in sizes * 2]
    assert hashing.blake3_many(items) == [blake3_plain(x) for x in items] and hashing.blake3_many([]) == []
    rows = spark.createDataFrame([(None,), (bytearray(b"abc"),), (bytearray(),)], "b binary")
    assert [r[0] for r in rows.select(hashing.blake3(F.col("b"))).collect()] == [None, hashing.blake3_hex(b"abc"), hashing.blake3_hex(b"")]
    assert hashing.blake3_hex(bytes(i % 251 for i in range(2049))).startswith("5f4d72f40d7a5f82")
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = ed25519.sign(seed, b"m")
    assert ed25519.verify(ed25519.public_key(seed), b"m", signature) and not ed25519.verify(ed25519.public_key(seed), b"n", signature)
    with pytest.raises(ValidationError):
        ed25519.sign(b"short", b"m")


@pytest.fixture
def bundled(spark):
    df = events(spark, dict(actor_id="u"), dict(raw_event_id=2))
    raw = spark.createDataFrame([(1, bytearray(b"one")), (2, bytearray(b"two"))], "raw_event_id long, content binary")
    ce = spark.createDataFrame([("c", 1, True, "x", T0), ("c", 2, False, "", T0)], "case_id string, event_id long, pinned boolean, annotation string, added_at timestamp_ntz")
    return ce, df, raw


def test_bundle(bundled):
    made = bundle.build("c", "Case", *bundled, bytes(32), "now")
    assert [r["path"] for r in made["integrity"]] == ["events/1.json", "raw/1.bin", "events/2.json", "raw/2.bin", "manifest.json"]
    assert all(bundle.verify(made, strict=True)[k] for k in ("integrity_valid", "chain_valid", "signature_valid"))
    for change, broken, strict in [
        (lambda b: b["events"].__setitem__(0, "{}"), "integrity_valid", False), (lambda b: b["raw_events"][0].update(content_base64="AAAA"), "integrity_valid", False),
        (lambda b: b["chain"].update(root_hash="0"), "chain_valid", False), (lambda b: b["chain"]["file_hashes"].reverse(), "signature_valid", False),
        (lambda b: b["manifest"].update(case_name="other"), "integrity_valid", True), (lambda b: b["signature"].update(algorithm="x"), "signature_valid", False),
    ]:
        copy = json.loads(json.dumps(made))
        change(copy)
        assert not bundle.verify(copy, strict)[broken]


def test_whole_cases_are_verified(spark):
    n = 1100  # more than a bundle in one piece holds
    df = events(spark, *(dict(raw_event_id=k) for k in range(1, n + 1)))
    raw = spark.createDataFrame([(k, bytearray(b"%d" % k)) for k in range(1, n + 1)], "raw_event_id long, content binary")
    ce = spark.createDataFrame([("big" if k <= 1050 else "small", k, T0) for k in range(1, n + 1)], "case_id string, event_id long, added_at timestamp_ntz")
    seed = bytes(32)
    records = bundle.integrity(ce, df, raw).localCheckpoint()
    signed = bundle.sign_cases(bundle.sealed(ce, records), seed)

    def found(df, raw, key=seed):
        return {r.case_id: tuple(r)[1:] for r in bundle.verify_cases(ce, df, raw, records, signed, ed25519.public_key(key)).collect()}

    assert found(df, raw) == {"big": (1050, 2100, 0, True, True, True), "small": (50, 100, 0, True, True, True)}
    changed = df.withColumn("severity", F.when(F.col("event_id") == 1049, 4).otherwise(F.col("severity")))
    assert found(changed, raw.where("raw_event_id <> 1100")) == {"big": (1050, 2100, 1, False, False, True), "small": (50, 99, 1, False, False, True)}
    assert not any(r[-1] for r in found(df, raw, bytes(range(32))).values())


def test_export(bundled):
    ce, df, _ = bundled
    attached = export.attach(ce, df)
    head = export.CaseHead("c", "Name", "me", "then")
    assert export.render(head, attached, "CSV", "now").splitlines()[1].endswith("+00:00,u,s,Info,x")
    md = export.render(head, attached, "md", "now")
    assert "# Investigation Report: Name" in md and "## Pinned Events" in md and "_No description provided._" in md
    assert len(json.loads(export.render(head, attached, "json", "now"))["events"]) == 2
    with pytest.raises(ValidationError):
        export.render(head, attached, "xml", "now")
    with pytest.raises(NotFoundError):
        export.attach(ce, df.where("event_id = 1"))


def test_cases_and_holds(spark, tmp_path):
    c = cases.Cases(spark, str(tmp_path))
    case_id = c.create("n", "me", T0)
    c.attach(case_id, 5, "me", T0)
    with pytest.raises(ValidationError):
        c.attach(case_id, 5, "me", T0)
    c.mark(case_id, 5, pinned=True, annotation="why")
    assert c.events(case_id).first().annotation == "why"
    c.patch(case_id, T0, status="closed")
    assert c.listed("closed").count() == 1 and c.listed("open").count() == 0
    c.detach(case_id, 5)
    for call in (lambda: c.detach(case_id, 5), lambda: c.get("x"), lambda: c.patch("x", T0, name="y")):
        with pytest.raises(NotFoundError):
            call()
    for call in (lambda: c.create("", "me", T0), lambda: c.create("n" * 201, "me", T0), lambda: c.patch(case_id, T0), lambda: c.patch(case_id, T0, status="odd")):
        with pytest.raises(ValidationError):
            call()
    h = holds.Holds(spark, str(tmp_path))
    hold_id = h.create("h", "time_range", {"a": 1}, "me", T0)
    df = events(spark, {}, {})
    wanted = holds.of_time_range(df, T0, T0 + timedelta(seconds=1))
    held = holds.missing(hold_id, wanted, spark.createDataFrame([], "hold_id string, event_id long"))
    assert held.count() == 1 and holds.missing(hold_id, wanted, held).count() == 0
    assert holds.held_events(df, held, h.listed()).count() == 1
    h.release(hold_id, T0)
    assert holds.held_events(df, held, h.listed()).count() == 0
    with pytest.raises(ValidationError):
        h.release(hold_id, T0)
    with pytest.raises(ValidationError):
        h.create("h", "odd", {}, "me", T0)


def test_a_chain_of_a_hot_entity_is_whole(spark):
    hot = events(spark, *(dict(src_ip="1.1.1.1", occurred_at=T0) for _ in range(701)))
    assert graph.chain(hot, 1, 1, 60).groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, 700)]
    assert graph.chain(hot, 1, 1, 60, per_entity=100).count() == 100 and graph.chain(hot, 1, 1, 60, limit=500).count() == 500


def test_a_time_range_is_held_whole(spark):
    many = spark.range(12_000).select(F.col("id").alias("event_id"), F.lit(T0).alias("occurred_at"))
    assert holds.of_time_range(many, T0, T0 + timedelta(seconds=1)).distinct().count() == 12_000
    assert holds.of_time_range(many, T0, T0, limit=5).count() == 5


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("010.0.0.1", "10.0.0.1"), (" 1.2.3.4 ", "1.2.3.4"), ("256.1.1.1", None), ("1.2.3", None), ("", None), (None, None), ("host", None), ("::1", "0000:" * 7 + "0001"), ("::", ":".join(["0000"] * 8)),
        ("2001:DB8::ff00:42:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329"), ("1:2:3:4:5:6:7:8", "0001:0002:0003:0004:0005:0006:0007:0008"), ("::ffff:1.2.3.4", "0000:0000:0000:0000:0000:ffff:0102:0304"),
        ("1::2::3", None), ("1:2:3", None), ("12345::", None), ("1:2:3:4:5:6:7:8::", None), (":1", None),
    ],
)
def test_addresses(spark, given, expected):
    assert spark.createDataFrame([(given,)], "x string").select(text.canonical_ip("x")).first()[0] == expected


def test_json_merge(spark):
    df = spark.createDataFrame([('{"a":1,"b":[2]}', '{"a":{"c":null}}'), (None, '{"x\\"":1}'), ("[1]", None)], "a string, b string")
    assert [json.loads(r[0]) for r in df.select(text.json_merged("a", "b")).collect()] == [{"a": {"c": None}, "b": [2]}, {'x"': 1}, {}]


def test_written_tables_are_released(spark):
    import glob
    import os

    from casebook.plans import storage

    storage.cut(spark.range(3))
    (path,) = (p for p in storage._WRITTEN[-1:])
    assert os.path.isdir(path.removeprefix("file:"))
    storage.release(spark)
    assert not glob.glob(path.removeprefix("file:")) and not storage._WRITTEN


def rows_scanned(df):
    """How many rows the scan of a plan has given out, after running it."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_point_lookups_pass_over_row_groups(spark, tmp_path):
    from casebook.sources import files

    # ids in no order, so that their ranges exclude nothing
    df = spark.range(20_000).select((F.pmod(F.col("id") * 7919, F.lit(20_011)) * 1_000_003).alias("event_id"), "id")
    many = df.select("event_id", F.lit(1).cast("long").alias("raw_event_id"), F.lit("a").alias("event_type"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("occurred_at"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    spark.conf.set("parquet.block.size", "65536")
    try:
        files.write_events(many, str(tmp_path / "events"))
        files.write_raw(many.select("raw_event_id", "content_hash", F.lit(T0).cast("timestamp_ntz").alias("received_at")), str(tmp_path / "raw"))
    finally:
        spark.conf.unset("parquet.block.size")
    wanted = many.where(F.col("content_hash") == F.sha2(F.lit("12345"), 256)).first()
    found = timeline.event_by_id(spark.read.parquet(str(tmp_path / "events")), wanted.event_id)
    assert found.count() == 1 and rows_scanned(found) < 20_000 / 3
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert rows_scanned(raw.where(F.col("content_hash") == wanted.content_hash)) < 20_000 / 3
    assert rows_scanned(raw.where("content_hash = 'none'")) == 0


# ---- stored indexes ------------------------------------------------------------------------------


def random_events(spark, n, seed=1):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    rows = [
        dict(
            event_type=pick("auth.login", "file.access"), occurred_at=T0 + timedelta(minutes=rng.randint(0, 600)), actor_id=pick(None, " a", "b", "C c"), actor_name=pick(None, "Ann", "Bo Li"), src_ip=pick(None, "1.1.1.1", "2.2.2.2"),
            dst_ip=pick(None, "1.1.1.1"), device_id=pick(None, "d1", "d2"), hostname=pick("", "h 1", "h2"), custom_fields=pick("{}", '{"session": "b"}'),
        )
        for _ in range(n)
    ]
    return events(spark, *rows)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    df = random_events(spark, 300).cache()
    made = Indexes(str(tmp_path_factory.mktemp("indexes")), buckets=4)
    for k in range(3):
        made.update(df.where(F.col("event_id") % 3 == k), k)
    return df, made


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_indexed_search(spark, indexed, monkeypatch):
    df, made = indexed
    for query in ("auth.login", "c AUTH.login", "bo li file.access h2", "nowhere", "s", "c c C"):
        for start, end in ((None, None), (T0 + timedelta(minutes=90), T0 + timedelta(minutes=400))):
            plain = search.found(df, query, start, end)
            assert same(search.indexed_hits(made.postings, spark, query, start, end), plain)
            assert same(search.indexed_total(made.postings, spark, query, start, end), search.total(df, query, start, end))
            assert [r.event_id for r in search.indexed_page(made.postings, df, query, 5, 3, start, end).collect()] == [r.event_id for r in search.page(df, query, 5, 3, start, end).collect()]
    with pytest.raises(ValidationError):
        search.indexed_hits(made.postings, spark, "  ")
    with pytest.raises(ValidationError):
        search.indexed_page(made.postings, df, "s", 1, -1)
    monkeypatch.setattr(search, "BLOCK", 7)
    blocks = search.posting_lists(df)
    assert blocks.agg(F.max("parts")).first()[0] > 1 and blocks.where("n <> size(ids)").count() == 0


def test_index_of_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 5)
    df = random_events(spark, 200, 7)
    made = Indexes(str(tmp_path), buckets=2)
    made.update(df.where("event_id <= 150"), 4)
    made.update(df.where("event_id > 150"), 9)
    made = made.compact(spark, 9)  # batches with different numbers of parts in one
    assert made.postings.batches(spark) == [9]
    assert same(search.indexed_hits(made.postings, spark, "s auth.login bo"), search.found(df, "s auth.login bo"))


def scan_of(df):
    """The file scans of a plan, with what they select."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "FileScan" in line], text


def test_lookups_read_their_buckets(spark, indexed):
    df, made = indexed
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    # where nothing is gained from the order of buckets Spark reads their files as any others (so a large bucket is many tasks), but only those of the bucket
    files = lambda rows: {r[0].rpartition("_")[2][:5] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert len(files(made.postings.of(spark, ["auth.login"]))) == 1 and len(files(made.postings.read(spark))) > 1
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        scans, _ = scan_of(search.indexed_hits(made.postings, spark, "auth.login"))
        assert len(scans) == 1 and "SelectedBucketsCount: 1 out of 4" in scans[0]
        scans, plan = scan_of(made.keys.of(spark, ["1.1.1.1"]).where("key_type = 'ip'").select("event_id", "occurred_at"))
        assert "SelectedBucketsCount: 1 out of 4" in scans[0] and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    _, plan = scan_of(made.entity_table(spark))
    assert "Exchange" not in plan  # parts of one entity share a bucket
    got = {(r.event_id, r.ord) for r in keys.stored_related(made.keys, df, 5, 1000).collect()}
    assert got == {(r.event_id, r.ord) for r in keys.related(keys.key_table(df), df, 5, 1000).collect()} and got
    assert {r.event_id for r in keys.stored_related(made.keys, df, 5, 1, exact=True).collect()} <= {e for e, _ in got}
    assert keys.stored_related(made.keys, df, 999_999).count() == 0
    assert [r.event_id for r in keys.stored_lookup(made.keys, df, "ip", "1.1.1.1", 7).orderBy(F.desc("occurred_at"), F.desc("event_id")).collect()] == [r.event_id for r in keys.lookup(keys.key_table(df), df, "ip", "1.1.1.1", 7).collect()]


def test_incremental_entities(spark, indexed):
    """Any batches, one of them twice, and compacted ones give what all events give at once."""
    df, made = indexed
    seen, rels = entities.observations(df), entities.relationships(entities.relation_observations(df))
    made.update(df.where("event_id % 3 = 1"), 1)
    after = made.compact(spark, 1)
    assert after.entities.batches(spark) == [1, 2] and after.entities.read(spark).where("batch = 1").groupBy("identifier", "entity_type").count().where("count > 1").count() == 0
    for indexes in (made, after):
        for by_ingest in (False, True):
            assert same(indexes.entity_table(spark, by_ingest), entities.entities(seen, by_ingest))
        assert same(indexes.relationships(spark), rels)
        assert same(indexes.entity(spark, "ip", "1.1.1.1"), entities.one(entities.entities(seen), "ip", "1.1.1.1"))
        assert same(indexes.relationships_of(spark, "ip", "1.1.1.1"), entities.relationships_of(rels, "ip", "1.1.1.1"))
        assert same(entities.merged_relationships(indexes.adjacency.read(spark)), rels)


def test_stored_graph(spark, indexed, monkeypatch):
    df, made = indexed
    rels = entities.relationships(entities.relation_observations(df))
    for limit in (10_000, 1):  # by a filter, and by a join that does not shuffle the adjacency
        monkeypatch.setattr(graph, "MAX_LITERALS", limit)
        for depth in (1, 2, 3):
            assert same(graph.stored_neighbourhood(made.adjacency, spark, "host", "h 1", depth), graph.neighbourhood(rels, "host", "h 1", depth))
            assert same(graph.stored_edges(made.adjacency, spark, "host", "h 1", depth), graph.induced_edges(rels, "host", "h 1", depth))
    assert graph.stored_neighbourhood(made.adjacency, spark, "host", "none", 2).count() == 0
    with pytest.raises(ValidationError):
        graph.stored_neighbourhood(made.adjacency, spark, "host", "h 1", 4)


def test_stored_table(spark, tmp_path):
    table = StoredTable(str(tmp_path / "t"), "k string, v long", "k", ("v",), 2)
    assert table.read(spark).count() == 0 and table.batches(spark) == []
    row = lambda *values: spark.createDataFrame([(v, n) for n, v in enumerate(values)], "k string, v long")
    table.write(row("a", None, "b"), 3)
    table.write(row("a"), 1)
    table.write(row("c", "a"), 3)
    assert sorted((str(r.k), r.batch) for r in table.read(spark).collect()) == [("a", 1), ("a", 3), ("c", 3)]
    spark.sql(f"drop table {table.name}")  # another session knows only the folder
    assert table.of(spark, ["a", "zz"]).count() == 2
    with pytest.raises(ValidationError):
        table.of(spark, ["x"] * 10_001)
    assert "Exchange" not in table.read(spark).groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
