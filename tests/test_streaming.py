import json
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from casebook.operators.sequences import BUILT_IN, Pattern, Step
from casebook.streaming import ingest, online, slots
from tests.plain import greedy

T0 = datetime(2026, 1, 1)


def test_file_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"event_type": "a.b", "occurred_at": "2026-01-01T00:00:00Z"}))
    (tmp_path / "in" / "b.csv").write_text("type,time\nx,2026-01-01T00:00:05Z\ny,2026-01-02T00:00:05Z\n")
    (tmp_path / "in" / "c.bin").write_text("?")
    stream = ingest.payload_stream(spark, str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), now=lambda: F.lit(datetime(2026, 2, 1)).cast("timestamp_ntz")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/events"))
    assert sorted(r.event_type for r in got.collect()) == ["a.b", "x", "y"]
    assert spark.read.parquet(str(tmp_path / "out/errors")).count() == 1
    assert got.transform(ingest.lagged).where("lag_seconds > 0").count() == 3
    assert ingest.counted(got).count() == 3


def test_attempts_agree_with_the_batch_search():
    rng, p = random.Random(5), BUILT_IN[1]
    for _ in range(200):
        rows = sorted((T0 + timedelta(seconds=rng.randint(0, 900)), k, rng.choice(["auth.login", "auth.login_failed", "x"])) for k in range(25))
        attempts, found = [], []
        for at, k, kind in rows:
            done = online.advance(attempts, (round(at.timestamp() * online.SECOND), k, kind), p)
            if done:
                found.append([i for _, i in done])
        assert found == greedy(rows, p)


def test_online_detection(spark, tmp_path):
    rows = [(1, "auth.login", T0, "u"), (2, "file.access", T0 + timedelta(seconds=5), " u"), (3, "data.export", T0 + timedelta(seconds=9), "u"), (4, "auth.login", T0, "v")]
    spark.createDataFrame(rows, "event_id long, event_type string, occurred_at timestamp_ntz, actor_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, event_type string, occurred_at timestamp_ntz, actor_id string").parquet(str(tmp_path / "in"))
    q = online.detect(stream, BUILT_IN[0]).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)  # timers go by event time, so a bounded run ends
    assert [(r.actor_id, r.event_ids) for r in spark.sql("select * from found").collect()] == [("u", "1,2,3")]


def plain_chains(rows, p, until):
    """Earliest event for each further step, from every event of the first step."""
    from casebook.functions.text import glob_matches

    out = []
    for k, (at, i, kind) in enumerate(rows):
        if at >= until or not glob_matches(p.steps[0].event_type_pattern, kind):
            continue
        chain, place = [(at, i)], k
        for step in p.steps[1:]:
            place = next((j for j in range(place + 1, len(rows)) if glob_matches(step.event_type_pattern, rows[j][2])), None)
            if place is None or (step.max_gap_secs is not None and rows[place][0] - chain[-1][0] > step.max_gap_secs * slots.SECOND):
                break
            chain.append(rows[place][:2])
        else:
            if chain[-1][0] - at <= p.max_total_duration_secs * slots.SECOND:
                out.append(chain)
    return out


def test_chains_of_a_slot():
    from casebook.functions.text import glob_matches

    rng = random.Random(2)
    for _ in range(300):
        p = Pattern("p", tuple(Step(rng.choice(["x", "y*", "*"]), rng.choice([None, 3, 20])) for _ in range(rng.randint(1, 4))), rng.choice([0, 10, 60]), False)
        rows = sorted((rng.randint(0, 50) * slots.SECOND, k, rng.choice("xyz")) for k in range(rng.randint(0, 30)))
        steps = [sum(glob_matches(s.event_type_pattern, kind) << k for k, s in enumerate(p.steps)) for _, _, kind in rows]
        mixed = [*zip(rows, steps, strict=True)] + [(r, s) for r, s in zip(rows, steps, strict=True) if rng.random() < 0.2]  # some are sent twice
        rng.shuffle(mixed)
        got = slots.chains(*(np.array(c, np.int64) for c in ([r[0] for r, _ in mixed], [r[1] for r, _ in mixed], [s for _, s in mixed])), p, 30 * slots.SECOND)
        assert [list(zip(t, i, strict=True)) for t, i in got] == plain_chains(rows, p, 30 * slots.SECOND)


def test_late_events_are_counted(spark, tmp_path):
    schema = "event_id long, event_type string, occurred_at timestamp_ntz, actor_id string"
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    files = ([(1, "a", at(0), "u"), (2, "a", at(20), "u"), (3, "a", at(600), "v")], [(5, "a", at(610), " v ")], [(4, "a", at(30), "u"), (6, "a", at(5000), "w")], [(7, "a", at(5001), "w")])
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.sessions(stream, "30 minutes", "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(120)
    got = {(r.actor_id, r.started_at, r.ended_at, r.n_events) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("u", at(0), at(20), 2), ("v", at(600), at(610), 2)} and ingest.late_rows(q) == 1


def test_linked_rows_meet_near_in_time(spark):
    """The join has a time slot among its keys, so a hot host meets only what is near, and gives what the plain definition gives."""
    import re

    rng = random.Random(8)
    schema = "event_id long, event_type string, occurred_at timestamp_ntz, actor_id string, actor_name string, src_ip string, dst_ip string, device_id string, hostname string"
    rows = [(k, rng.choice("rx"), T0 + timedelta(seconds=rng.randint(-3600, 3600)), None, None, None, None, None, rng.choice("gh")) for k in range(150)]
    rows += [(200 + k, "rx"[k % 2], T0 + timedelta(seconds=s), None, None, None, None, None, "g") for k, s in enumerate((0, 300, 600, -300, -600))]
    events = spark.createDataFrame(rows, schema)
    found = ingest.linked(events, events.where("event_type = 'r'"), 600)
    half = timedelta(seconds=300)
    want = sorted((r[0], s[0]) for r in rows for s in rows if r[1] == "r" and r[8] == s[8] and r[0] != s[0] and r[2] - half <= s[2] < r[2] + half)
    assert sorted((r.from_id, r.event_id) for r in found.collect()) == want
    keys = re.search(r"Join \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "slot" in keys
