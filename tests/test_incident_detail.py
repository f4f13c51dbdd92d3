"""The bundle of an incident: sections, their order, gapless places, nulls."""

import json

from cinderlake.operators import correlation as C

COLUMNS = "alert_id string, rule_id string, technique string, pos long, event_id string, t long, severity int, confidence string, entities array<string>, hostname string, username string, source_ip string, action string, outcome string, identity_type string"
S = 1_000_000


def row(alert, rule, technique, pos, t, severity, entities, **more):
    return (alert, rule, technique, pos, f"ev-{pos}", t * S, severity, "high", entities, more.get("host"), more.get("user"), None, "act", more.get("outcome"), None)


def details(spark, rows):
    evidence = spark.createDataFrame(rows, COLUMNS)
    owned, incidents = C.incidents_of(evidence)
    found = C.bundle(C.details(owned, incidents, evidence, C.risk_factors(owned, incidents, evidence))).collect()
    return {(r.incident_id, r.section, r.place): json.loads(r.item) for r in found}


def test_sections(spark):
    rows = [
        row("a1", "R2", "T1110", 1, 100, 2, ["host:h", "user:b:c"], host="h", user="b:c"), row("a1", "R2", "T1110", 2, 90, 2, ["host:h"], host="h", outcome="failure"),
        row("a2", "R1", "T1059", 2, 90, 4, ["host:h"], host="h", outcome="failure"), row("a3", "R1", None, 3, 200, 4, ["host:h", "ip:9.9.9.9"], host="h"),
        row("far", "R9", "T9999", 4, 900_000, 0, []),
    ]
    got = details(spark, rows)
    section = lambda i, s: [v for (a, b, _), v in sorted(got.items()) if (a, b) == (i, s)]
    assert [x["alert_id"] for x in section("inc-0001", "alert")] == ["a2", "a3", "a1"] and [p for a, b, p in sorted(got) if (a, b) == ("inc-0001", "alert")] == [1, 2, 3]
    assert [(x["alert_id"], x["tactic"]) for x in section("inc-0001", "chain")] == [("a1", "Credential Access"), ("a2", "Execution"), ("a3", None)]
    assert section("inc-0001", "timeline") == [{"event_id": "ev-2", "action": "act", "outcome": "failure", "n_alerts": 2}, {"event_id": "ev-1", "action": "act", "outcome": None, "n_alerts": 1}, {"event_id": "ev-3", "action": "act", "outcome": None, "n_alerts": 1}]
    assert section("inc-0001", "entity") == [{"value": v} for v in ("9.9.9.9", "b:c", "h")]
    assert section("inc-0001", "mitre") == [{"technique": t, "n_rules": 1, "n_alerts": 1} for t in ("T1059", "T1110")]
    assert section("inc-0001", "incident")[0]["n_events"] == 3 and section("inc-0001", "risk")[0]["score"] > section("inc-0002", "risk")[0]["score"]
    assert section("inc-0002", "entity") == [] and [x["tactic"] for x in section("inc-0002", "chain")] == [None]


def test_hot_and_empty(spark):
    hot = [row(f"a{i:04d}", "R", "T1110", i, i, 1, ["host:h"], host="h") for i in range(600)]
    got = details(spark, hot)
    assert {i for i, _, _ in got} == {"inc-0001"} and [p for _, s, p in sorted(got) if s == "timeline"] == list(range(1, 601))
    assert details(spark, []) == {}
