import json
from datetime import datetime

import pytest

from casebook.errors import NotFoundError, ParseError, PayloadTooLargeError, ValidationError
from casebook.operators import bundle
from casebook.operators.sequences import Pattern, Step
from casebook.operators.timeline import Filters
from casebook.workspace import Workspace


def event(kind, second, **more):
    return json.dumps({"event_type": kind, "occurred_at": f"2026-01-01T00:00:{second:02d}Z", "actor": {"id": "u"}, "network": {"src_ip": "10.0.0.1"}} | more).encode()


def test_an_investigation(spark, tmp_path):
    w = Workspace(spark, str(tmp_path), "ann")
    assert w.timeline() == ([], None) and w.entity_table().count() == 0 and w.scan_sequences() == 0
    w.ingest([event("auth.login", 1), event("file.access", 2), event("data.export", 3, severity="high")], "application/json", "idp")
    w.ingest([b"<35>1 2026-01-01T00:00:09Z gw sshd 1 - denied"], "text/syslog", "gw")
    rows, cursor = w.timeline(limit=2)
    assert [r.event_type for r in rows] == ["syslog.sshd", "data.export"] and cursor
    assert [r.event_type for r in w.timeline(cursor=cursor)[0]] == ["file.access", "auth.login"]
    export = w.timeline(Filters(event_types=["data.export"]))[0][0]
    assert w.event_raw(export.event_id).hash_verified and w.event(export.event_id).severity == 3
    assert w.correlated(export.event_id).count() == 2 and w.search("DATA.EXPORT")[0] == 1
    assert w.entity("user", "u")[0].event_count == 3 and w.list_entities("host").first().identifier == "gw"
    assert w.search_entities("0.0").count() == 1 and w.entity_timeline("user", "u").count() == 3
    near, edges = w.entity_graph("user", "u")
    assert near.count() == 1 and edges.count() == 1
    found, members = w.chain(export.event_id, 1, 60)
    assert found.count() == 3 and members.count() == 2
    w.add_pattern(Pattern("denied", (Step("syslog.*"),), 10, False))
    assert w.scan_sequences() == 2 and w.scan_sequences() == 0 and w.detected_sequences().count() == 2 and len(w.patterns()) == 4
    with pytest.raises(ValidationError):
        w.add_pattern(Pattern("denied", (Step("x"),), 1))
    assert [f[0] for f in w.replay(datetime(2026, 1, 1), datetime(2026, 1, 2), 0, entity=("user", "u"))] == ["event"] * 3 + ["done"]
    case_id = w.cases.create("Case", "ann", datetime(2026, 1, 2))
    w.cases.attach(case_id, export.event_id, "ann", datetime(2026, 1, 2), True, "why")
    assert "data.export" in w.export_case(case_id, "md") and json.loads(w.export_case(case_id))["case"]["name"] == "Case"
    assert all(v for k, v in bundle.verify(w.bundle_case(case_id, bytes(32)), True).items() if k != "details")
    for kind, criteria, n in [("case", {"case_id": case_id}, 1), ("entity", {"entity_type": "user", "identifier": "u"}, 3), ("query", {"min_severity": 3}, 2), ("time_range", {"start": "2026-01-01T00:00:01", "end": "2026-01-01T00:00:02"}, 2)]:
        hold_id = w.holds.create("h", kind, criteria, "ann", datetime(2026, 1, 2))
        assert w.materialise(hold_id) == n and w.materialise(hold_id) == 0
    assert w.is_held(export.event_id)
    with pytest.raises(ValidationError):
        w.materialise(w.holds.create("h", "case", {}, "ann", datetime(2026, 1, 2)))
    assert {r.action for r in w.audit().collect()} >= {"ingest", "scan", "export", "bundle", "materialise"} and w.audit("ingest").count() == 2


def test_ingest_is_all_or_nothing(spark, tmp_path):
    w = Workspace(spark, str(tmp_path))
    with pytest.raises(ParseError):
        w.ingest([event("a", 1), b"{oops"], "application/json")
    with pytest.raises(ParseError):
        w.ingest([b"?"], "application/octet-stream")
    with pytest.raises(ValidationError):
        w.ingest([json.dumps({"event_type": "a", "occurred_at": "2999-01-01T00:00:00Z"}).encode()], "application/json")
    with pytest.raises(ValidationError):
        w.ingest([event("a", 1)], "application/json", source_id="s" * 300)
    with pytest.raises(PayloadTooLargeError):
        w.ingest([b"<34>" + b"x" * 1_100_000], "text/syslog")
    assert w.events().count() == 0
    for call in (lambda: w.event(1), lambda: w.event_raw(1), lambda: w.entity("user", "x"), lambda: w.export_case("x")):
        with pytest.raises(NotFoundError):
            call()


def test_indexes_of_events_that_are_there(spark, tmp_path):
    w = Workspace(spark, str(tmp_path))
    w.ingest([event("auth.login", 1), event("file.access", 2)], "application/json", "idp")
    w.index()
    w.ingest([event("data.export", 3, actor={"id": " u "})], "application/json", "idp")
    found = w.timeline(Filters(event_types=["data.export"]))[0][0]
    assert w.search("idp")[0] == 3 and w.search("data.export")[1][0].event_id == found.event_id and w.entity("user", "u")[0].event_count == 3
    assert w.correlated(found.event_id).count() == 2 and [x.count() for x in w.entity_graph("user", "u")] == [1, 1] and w.relationships().first().event_count == 3
    w.index()
    assert w.search("idp")[0] == 3 and w.entity_table().where("identifier = 'u'").first().event_count == 3
