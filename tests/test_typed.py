"""Valid event documents: normalization, detections that cite them, and the fields that context items show."""

import json

import pytest
from pyspark.sql import functions as F

from cinderlake.operators import typed


def event(**more):
    return {"event_id": " e ", "timestamp": "2024-01-01T00:00:00,5Z", "source": "s", "category": "process", "action": "start", "outcome": "success", "severity": "high", "host": {"hostname": "H1", "ip": "10.0.0.9"}, "process": {"name": "p.exe", "command_line": "x --password Winter1 " + "y" * 300}, "user": {"name": "bob"}} | more


CLOUD = {"event_name": "CreateKey", "event_source": "iam", "account_id": "111122223333", "identity_type": "IAMUser", "principal_arn": "arn:aws:iam::111122223333:user/bob", "access_key_id": "AKIA" + "A" * 16, "mfa_authenticated": False, "source_ip": "8.8.8.8", "user_agent": "cli token=abcdef", "resources": ["r1", 5, "r2", "r1", "r3", "r4", "r5"], "request_parameters": {"roleArn": "r6", "bucketName": "r2", "groupId": 7, "password": "pw", "n": 3, "userName": "eve", "description": "for bob", "policyDocument": "{}", "deep": {"a": 1}, "none": None}, "response_elements": {"accessKeyId": "ASIA" + "B" * 16}}
DOCS = [
    event(),
    event(event_id="c", category="cloud", cloud=CLOUD, process={}, host={}),
    event(event_id="a", category="alert", alert={"rule_id": 7, "rule_name": "R of bob", "technique_ids": ["t1059", "bad", "T1059"], "destination_ip": "2001:DB8::1", "destination_port": "22", "source_port": 70000}, user={}),
    event(event_id="d", category="dns", dns={"query_name": "q.test", "source_ip": 5, "destination_port": 53, "destination_ip": "1.1.1.1"}, process=[], user={"name": 9}),
    event(event_id="x", severity="fatal"),
    ["no object"],
    None,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, None if d is None else json.dumps(d), "clash") for i, d in enumerate(DOCS)], "pos int, raw string, event_id string")
    return rows.select("pos", F.col("pos").alias("place"), F.lit(1).alias("pack"), F.parse_json("raw").alias("v"), "event_id")


def test_normalized(docs):
    found = {r.pos: r for r in typed.normalized(docs).withColumn("timestamp", F.unix_millis("timestamp")).collect()}
    assert sorted(found) == [0, 1, 2, 3] and {r.pos for r in typed.rejected(docs).collect()} == {4, 5, 6}
    p, c, a, d = (found[i] for i in range(4))
    assert (p.event_id, p.timestamp, p.severity, p.source_ip, p.process, p.action, p.resource, p.issues) == (" e ", 1704067200500, 3, "10.0.0.9", "p.exe", "start", [], [])
    assert (c.action, c.account, c.source_ip, c.resource, c.hostname, c.username) == ("CreateKey", "111122223333", "8.8.8.8", ["r1", "r2", "r3", "r4", "r5", "r6"], None, "bob")
    assert (a.technique, a.destination_ip, a.destination_port, a.source_port, a.username, a.issues) == (["T1059"], "2001:db8::1", None, None, None, ["invalid_port:source_port"])
    assert (d.source_ip, d.destination_port, d.process, d.username) == ("10.0.0.9", 53, None, "9")


def test_detections_keep_their_order(spark, docs):
    rows = [(3, "a", "z", "r1", ["T1003", "bad"]), (1, "a", "b", "r2", ["T1110.003", "T1059"]), (2, "a", "z", "r1", None), (5, "gone", "q", "r", []), (6, None, "q", "r", []), (4, "c", None, None, [None])]
    found = typed.with_detections(typed.normalized(docs), spark.createDataFrame(rows, "place int, event_id string, detection_id string, rule_id string, techniques array<string>"))
    by_id = {r.event_id: (r.detection_id, r.rule_id, r.technique) for r in found.collect()}
    assert by_id == {" e ": ([], [], []), "c": ([], [], []), "d": ([], [], []), "a": (["b", "z"], ["r2", "r1"], ["T1059", "T1110.003", "T1003"])}


def test_item_fields(docs):
    found = {r.pos: (json.loads(r.fields), json.loads(r.untrusted)) for r in typed.item_fields(docs.where("pos < 4"), "pos", "pack").collect()}
    fields, free = found[0]
    assert fields == {"category": "process", "action": "start", "outcome": "success", "severity": "high", "source": "s", "actor": "USER_001", "host": "H1", "source_ip": "10.0.0.9", "process": "p.exe"}
    assert list(free) == ["command_line"] and len(free["command_line"]) == 240 and free["command_line"].startswith("x --password [REDACTED_CLI_PASSWORD] yyy") and free["command_line"].endswith("y…")
    fields, free = found[1]
    assert list(fields) == sorted(fields) and "process" not in fields and "host" not in fields
    assert (fields["account"], fields["access_key"], fields["minted_access_key"], fields["mfa"], fields["api_call"], fields["principal"]) == ("AWS_ACCOUNT_001", "ACCESS_KEY_001", "ACCESS_KEY_002", False, "CreateKey", "arn:aws:iam::AWS_ACCOUNT_001:user/USER_001")
    assert fields["resources"] == ["r1", "r2", "r1", "r3", "r4"]
    assert fields["params"] == {"bucketName": "r2", "groupId": 7, "n": 3, "password": "[REDACTED_SECRET_FIELD]", "roleArn": "r6", "userName": "USER_002"}
    assert free == {"role_description": "for USER_001", "user_agent": "cli token=[REDACTED_SECRET_ASSIGNMENT]"}
    assert found[2][0]["vendor_rule"] == "7" and found[2][0]["destination"] == "2001:DB8::1:None" and found[2][1]["vendor_rule_name"] == "R of USER_001" and "actor" not in found[2][0]
    assert found[3][0]["domain"] == "q.test" and found[3][0]["destination"] == "1.1.1.1:53" and found[3][1] == {}


def test_empty(docs):
    none = docs.where("false")
    assert typed.normalized(none).count() == 0 and typed.item_fields(none, "pos", "pack").count() == 0
