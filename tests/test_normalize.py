"""Normalization of events of several shapes."""

import json

import pytest
from pyspark.sql import functions as F

from cinderlake.operators import normalize

RAWS = [
    {"id": "a", "@timestamp": "2024-01-02T03:04:05Z", "level": "HIGH", "user": {"name": " bob "}, "src_ip": "10.0.0.1", "dport": "443", "technique_ids": ["t1059.001", "bad", "T1059.001"], "rule": "r1"},
    {"event.id": "dotted", "event": {"id": "nested"}, "ts": 1704164645, "severity": 9, "src": "2001:DB8:0:0::1", "sport": 70000},
    {"time": 1704164645500, "severity": "weird", "hostname": True, "client_ip": "ec2.amazonaws.com", "resources": ["x", 5, "x", None, {}]},
    {"event_id": None, "uid": "u", "timestamp": "2024-01-02 03:04:05", "command": "c" * 600, "severity": "3", "src_ip": "010.0.0.1", "source": "  "},
    {"timestamp": "yesterday", "severity": -2.5, "username": {"name": "x"}},
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, json.dumps(r), "clash") for i, r in enumerate(RAWS)] + [(5, "[1]", ""), (6, "{", ""), (7, None, "")]
    df = spark.createDataFrame(rows, "pos int, raw string, username string")
    assert {r.pos: r.reason for r in normalize.rejected(df).collect()} == {5: "not_an_object", 6: "not_json", 7: "missing"}
    out = normalize.normalized(df).withColumn("timestamp", F.unix_millis("timestamp"))
    assert {r.issue: r.n for r in normalize.report(out).collect()}["invalid_type:hostname"] == 1
    return {r.pos: r for r in out.collect()}


def test_rows(found):
    assert sorted(found) == [0, 1, 2, 3, 4]
    a, b, c, d, e = (found[i] for i in range(5))
    at = 1704164645000
    assert (a.event_id, a.timestamp, a.severity, a.username, a.source_ip, a.destination_port, a.technique, a.rule_id, a.issues) == ("a", at, 3, "bob", "10.0.0.1", 443, ["T1059.001"], ["r1"], [])
    assert (b.event_id, b.timestamp, b.severity, b.source_ip, b.source_port, b.issues) == ("dotted", at, 4, "2001:db8::1", None, ["invalid_port:source_port"])
    assert (c.event_id, c.timestamp, c.severity, c.hostname, c.source_ip, c.resource) == ("anon-000002", at + 500, 0, None, None, ["x", "5"])
    assert sorted(c.issues) == ["invalid_ip:source_ip", "invalid_severity", "invalid_type:hostname"]
    assert (d.event_id, d.timestamp, len(d.command), d.severity, d.source_ip, d.source) == ("u", at, 512, 3, None, None)
    assert sorted(d.issues) == ["invalid_ip:source_ip", "truncated:command"]
    assert (e.event_id, e.timestamp, e.severity, e.username) == ("anon-000004", None, 0, None)
    assert sorted(e.issues) == ["invalid:timestamp", "invalid_type:username"]


def test_empty(spark):
    assert normalize.normalized(spark.createDataFrame([], "pos int, raw string")).count() == 0
