import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casebook.errors import ParseError
from casebook.sources import parsers
from tests.plain import csv_plain

NOW = datetime(2030, 1, 1)


def run(spark, parser, payload, **more):
    df = spark.createDataFrame([(1, payload)], "raw_event_id long, payload string")
    return parser(df, now=F.lit(NOW).cast("timestamp_ntz"), **more).orderBy("ordinal").collect()


def test_json_all_fields(spark):
    body = {
        "event_type": "vault.read", "occurred_at": "2026-02-03T08:15:00+02:00", "observed_at": "2026-02-03T08:15:01Z", "severity": "HIGH", "actor": {"id": "carol", "type": "user"},
        "network": {"src_ip": "198.51.100.4", "src_port": 80}, "device": {"hostname": "h"}, "tags": ["ops"], "session_id": "s-9", "n": 5,
    }
    (r,) = run(spark, parsers.parse_json, json.dumps(body))
    assert r.error is None and r.occurred_at == datetime(2026, 2, 3, 6, 15) and r.severity == 3 and r.actor_type == "user" and r.src_port == 80 and r.tags == ["ops"]
    assert json.loads(r.custom_fields) == {"n": 5, "session_id": "s-9"}
    assert [tuple(h) for h in r.hints] == [("identity", "carol"), ("ip", "198.51.100.4"), ("host", "h")]


@pytest.mark.parametrize(
    ("payload", "n", "bad"),
    [
        ('[{"event_type":"a","occurred_at":"2026-02-03T08:15:00Z"},{"event_type":"b","occurred_at":"2026-02-03T08:15:00Z"}]', 2, False),
        ('[{"event_type":"a","occurred_at":"2026-02-03T08:15:00Z"},{"event_type":"b","occurred_at":"yesterday"}]', 1, True),
        ("[]", 0, False), ("", 1, True), (None, 1, True), ("  ", 1, True), ("{oops", 1, True), ('{"occurred_at":"2026-02-03T08:15:00Z"}', 1, True), ("5", 1, True),
        ('{"event_type":7,"occurred_at":"2026-02-03T08:15:00Z"}', 1, True), ('{"event_type":"a","occurred_at":"2026-02-03"}', 1, True),
    ],
)
def test_json_errors(spark, payload, n, bad):
    got = run(spark, parsers.parse_json, payload)
    assert len(got) == n and all((r.error is not None) == bad for r in got)


@pytest.mark.parametrize(("name", "value"), [("Critical", 4), ("high", 3), ("Medium", 2), ("low", 1), ("info", 0), ("odd", 0)])
def test_severities(spark, name, value):
    (r,) = run(spark, parsers.parse_json, json.dumps({"event_type": "a", "occurred_at": "2026-02-03T08:15:00Z", "severity": name}))
    assert r.severity == value


def test_csv(spark):
    text = 'Event_Type,Time,user,ip,level,extra,host\nlogin,2026-02-03T08:00:00Z,bob,10.0.0.1,High,"a,b",\n,bad, , ,,,,over\n'
    a, b = run(spark, parsers.parse_csv, text)
    assert (a.event_type, a.actor_id, a.severity, a.hostname, json.loads(a.custom_fields)) == ("login", "bob", 3, None, {"extra": "a,b"})
    assert (b.event_type, b.occurred_at, b.actor_id) == ("csv.event", NOW, None)
    assert run(spark, parsers.parse_csv, "type,time\n") == []
    assert run(spark, parsers.parse_csv, "")[0].error


@pytest.mark.parametrize(
    ("line", "kind", "severity", "host", "message"),
    [
        ("<134>1 2026-02-03T08:00:00Z gw1 proxy 77 M1 upstream slow", "syslog.proxy", 1, "gw1", "upstream slow"),
        ("<134>1 2026-02-03T08:00:00Z - cron - - tick", "syslog.cron", 1, None, "tick"),
        ("<35>Feb  3 08:00:00 gw2 sshd[9]: denied", "syslog.sshd", 3, "gw2", "denied"),
        ("<34>FEB 3 08:00:00 gw2 no app here", "syslog.unknown", 4, "gw2", "no app here"),
        ("<134>free text", "syslog.unknown", 1, None, "free text"),
        ("<191>x", "syslog.unknown", 0, None, "x"),
    ],
)
def test_syslog(spark, line, kind, severity, host, message):
    (r,) = run(spark, parsers.parse_syslog, f"\n  {line}\n\n", year=F.lit(2026))
    assert (r.error, r.event_type, r.severity, r.hostname, json.loads(r.custom_fields)["message"]) == (None, kind, severity, host, message)
    if not line.endswith(("text", "x")):
        assert r.occurred_at == datetime(2026, 2, 3, 8)


@pytest.mark.parametrize("payload", ["no priority", "<192>x", "<1234>x", "", " \n ", "<34>ok\nbad"])
def test_syslog_errors(spark, payload):
    (r,) = run(spark, parsers.parse_syslog, payload)
    assert r.error


@pytest.mark.parametrize(
    ("stamp", "at"),
    [("2026-02-03T08:00:00Z", datetime(2026, 2, 3, 8)), ("2026-02-03T08:00:00.5", datetime(2026, 2, 3, 8, 0, 0, 500000)), (1770105600, datetime(2026, 2, 3, 8)), ("1770105600000", datetime(2026, 2, 3, 8)), (1770105600000, datetime(2026, 2, 3, 8))],
)
def test_webhook_times(spark, stamp, at):
    (r,) = run(spark, parsers.parse_webhook, json.dumps({"timestamp": stamp, "type": "user.delete", "user": {"id": "u", "email": "e"}, "ip": "1.2.3.4", "details": {"a": 1}}))
    assert (r.occurred_at, r.severity, r.tags, r.actor_type) == (at, 2, ["template"], "user")
    assert json.loads(r.custom_fields) == {"details": {"a": 1}, "raw_type": "user.delete"}


def test_registry(spark):
    df = spark.createDataFrame([(1, "<34>a", "text/plain"), (2, "?", "text/csv; charset=utf-8"), (3, " {}", "text/csv")], "raw_event_id long, payload string, content_type string")
    got = {r.raw_event_id: (r.parser_id, r.error) for r in parsers.parse(df).collect()}
    assert got[1] == ("syslog", None) and got[2] == (None, "no parser found") and got[3][0] == "json_generic" and got[3][1]
    with pytest.raises(ParseError):
        parsers.parse(df, "nope")
    with pytest.raises(ParseError):
        parsers.raise_errors(parsers.parse(df))
    assert parsers.parse(df, registry=()).where("error is null").count() == 0


def test_csv_against_the_standard_reader(spark):
    """Quoted separators and line ends, doubled and misplaced quotes, short and long lines, repeated headers."""
    rng = random.Random(9)
    heads = ["type", " User", "user_id", "IP", "host", "note", "note", "other \"x\"", "", "é,ü"]
    cells = ["", " ", "a", " b c ", "x,y", "two\nlines", 'say "hi"', '""', "10.0.0.1", "ß漢", "a\r\nb"]

    def quoted(c):
        return '"' + c.replace('"', '""') + '"' if rng.random() < 0.3 or set(c) & set(',"\r\n') else c

    texts = ["", "\n\n", "type\n", "\n\ntype\r\na\r\n\r\nb", '"type"\n"a', 'type,x\na"b,c\n"d"e,f', 'a"', "﷐,type\n1,2", '"a""', "type,type\na,\n,b\n , "]
    for _ in range(300):
        n = rng.randint(1, 6)
        lines = [[rng.choice(heads) for _ in range(n)]] + [[rng.choice(cells) for _ in range(rng.randint(1, 7))] for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice(["\n", "\r\n"]).join(",".join(quoted(c) for c in line) for line in lines) + rng.choice(["", "\n"]))
        texts.append("".join(rng.choice('ab,"\n ') for _ in range(rng.randint(1, 25))))
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "k int, payload string")
    got = {}
    for r in parsers.parse_csv(df, now=F.lit(NOW).cast("timestamp_ntz")).orderBy("k", "ordinal").collect():
        got.setdefault(r.k, []).append(r)
    for k, text in enumerate([*texts, None]):
        expected = csv_plain(text)
        if expected is None:
            assert [r.error is None for r in got[k]] == [False], text
            continue
        rows = got.get(k, [])
        assert [r.ordinal for r in rows] == list(range(len(expected))) and all(r.error is None for r in rows), text
        for r, (found, custom) in zip(rows, expected, strict=True):
            assert (r.event_type, r.actor_id, r.src_ip, r.hostname) == (found.get("event_type", "csv.event"), found.get("actor_id"), found.get("src_ip"), found.get("hostname")), text
            assert json.loads(r.custom_fields) == custom, text
