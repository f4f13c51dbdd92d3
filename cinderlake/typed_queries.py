"""Queries over event documents of every category made from the telemetry, with their SQL twins (DuckDB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.operators import typed
from cinderlake.registry import twin
from cinderlake.sources.telemetry import SEVERITIES
from cinderlake.sources.telemetry import TELEMETRY_SQL as SEC
from cinderlake.sources.telemetry import telemetry

#: The category of a document: a fifth of the processes look up names. Severities by number.
_CATEGORY = "CASE WHEN category = 'process' AND k % 5 = 0 THEN 'dns' ELSE category END"
_SEVERITY = "CASE severity " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEVERITIES)) + " END"
#: Texts in both dialects: keys of a user and those minted for them, and command lines of which some are long.
_KEY, _MINTED = "'AKIA' || lpad(CAST(user_id AS STRING), 16, '0')", "'ASIA' || lpad(CAST(user_id AS STRING), 16, '0')"
_PAD = "CASE WHEN k % 4 = 0 THEN repeat('y', 300) ELSE '' END"


def _documents(spark, sf_dir):
    """(pos, user_id, v): one valid document an event, the details by category; every 97th has a fault."""
    rows = telemetry(spark, sf_dir, dealt=True).withColumn("kind", F.expr(_CATEGORY))
    told = {
        "event_id": "event_id", "timestamp": "'2024-01-01T00:00:' || lpad(CAST(k % 60 AS STRING), 2, '0') || '+01:00'", "source": "source", "category": "kind", "action": "IF(kind = 'cloud', 'api_call', action)", "outcome": "IF(pos % 97 = 0, 'maybe', outcome)", "severity": _SEVERITY,
        "host": "IF(kind = 'cloud', NULL, named_struct('hostname', coalesce(hostname, 'H'), 'ip', source_ip))", "user": "named_struct('name', username)", "auth": "IF(kind = 'authentication', named_struct('source_ip', source_ip), NULL)",
        "process": f"IF(kind IN ('process', 'alert'), named_struct('name', process, 'parent_name', parent_process, 'command_line', 'tool --password Winter' || k || ' for ' || username || ' ' || {_PAD}, 'hash_sha256', 'h' || k), NULL)",
        "network": "IF(kind = 'network', named_struct('source_ip', source_ip, 'destination_ip', destination_ip, 'destination_port', destination_port, 'source_port', IF(k % 2 = 0, 70000, 50000 + k)), NULL)", "dns": "IF(kind = 'dns', named_struct('query_name', 'host' || k || '.example.test'), NULL)",
        "alert": "IF(kind = 'alert', named_struct('rule_id', rule_id, 'rule_name', 'Rule seen for ' || username, 'technique_ids', array(lower(technique), 'bad', technique)), NULL)",
        "cloud": f"IF(kind = 'cloud', named_struct('event_name', action, 'event_source', 'iam.test', 'account_id', account, 'identity_type', identity_type, 'principal_arn', principal_arn, 'access_key_id', {_KEY}, 'mfa_authenticated', k % 2 = 0, 'source_ip', source_ip, 'user_agent', 'cli token=abc' || k, 'resources', array(resource, 'r1', 'r2', 'r1', 'r3', 'r4'), "
        f"'request_parameters', named_struct('bucketName', resource, 'roleArn', 'role-' || (k % 9), 'groupId', k, 'password', 'pw' || k, 'userName', username, 'description', 'run by ' || username, 'deep', named_struct('a', 1)), 'response_elements', IF(action = 'AssumeRole', named_struct('accessKeyId', {_MINTED}), NULL)), NULL)",
    }
    document = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in told.items()]))
    return rows.select("pos", "user_id", "event_id", "alert_id", "technique", "seed", F.col("pos").alias("place"), F.parse_json(document).alias("v"))


_DOC = f"{SEC}, d AS (SELECT *, {_CATEGORY} AS kind, {_SEVERITY} AS level FROM sec)"
_JOINED = "array_to_string({}, ',')"
_CLOUD = "CASE WHEN kind = 'cloud' THEN {} END"
_TOLD = "CASE WHEN kind IN ('process', 'alert') THEN {} END"


@twin(f"""WITH {_DOC} SELECT pos, event_id, 1704063600 + k % 60 AS at, kind AS event_type, severity, CASE WHEN kind <> 'cloud' THEN coalesce(hostname, 'H') END AS hostname, source_ip, destination_ip, CASE WHEN kind = 'network' AND k % 2 = 1 THEN CAST(50000 + k AS INTEGER) END AS source_port, CAST(destination_port AS INTEGER) AS destination_port,
  username, account, {_TOLD.format("process")} AS process, {_TOLD.format("parent_process")} AS parent_process, {_TOLD.format(f"trim('tool --password Winter' || k || ' for ' || username || ' ' || {_PAD})")} AS command, action, outcome AS status, coalesce(technique, '') AS techniques,
  CASE WHEN kind = 'cloud' THEN resource || ',r1,r2,r3,r4,role-' || (k % 9) ELSE '' END AS resources, CASE WHEN kind = 'network' AND k % 2 = 0 THEN 'invalid_port:source_port' ELSE '' END AS issues FROM d WHERE pos % 97 <> 0""")
def typed_events(spark, sf_dir):
    """Valid event documents of all six categories as normalized events, with the issues found."""
    rows = typed.normalized(_documents(spark, sf_dir))
    lists = [F.array_join(c, ",").alias(n) for c, n in (("technique", "techniques"), ("resource", "resources"), ("issues", "issues"))]
    return rows.select("pos", "event_id", F.unix_seconds("timestamp").alias("at"), "event_type", "severity", "hostname", "source_ip", "destination_ip", "source_port", "destination_port", "username", "account", "process", "parent_process", "command", "action", "status", *lists)


_CITE = """c AS (SELECT event_id, pos * 10 AS place, alert_id AS id, technique AS t FROM sec WHERE seed UNION ALL SELECT event_id, pos * 10 + 1, 'sum-' || user_id, 'T1078' FROM sec WHERE k % 3 = 0 UNION ALL SELECT event_id, pos * 10 + 2, alert_id, 'T1078' FROM sec WHERE seed)"""


@twin(f"""WITH {_DOC}, {_CITE}, ids AS (SELECT event_id, id, min(place) AS p FROM c GROUP BY ALL), ts AS (SELECT event_id, t, min(p) AS p FROM (SELECT event_id, t, place AS p FROM c UNION ALL SELECT event_id, technique, -1 FROM sec WHERE technique IS NOT NULL) GROUP BY ALL)
  SELECT event_id, coalesce((SELECT string_agg(id, ',' ORDER BY p) FROM ids WHERE ids.event_id = d.event_id), '') AS alerts, coalesce((SELECT string_agg(t, ',' ORDER BY p) FROM ts WHERE ts.event_id = d.event_id), '') AS techniques FROM d WHERE pos % 97 <> 0""")
def typed_detections(spark, sf_dir):
    """Normalized events with all detections that cite them, in order and each once, after their own techniques."""
    docs, rows = _documents(spark, sf_dir), telemetry(spark, sf_dir)
    cited = lambda cond, n, alert, technique: rows.where(cond).select((F.col("pos") * 10 + n).alias("place"), "event_id", F.expr(alert).alias("detection_id"), F.lit("R").alias("rule_id"), F.array(F.expr(technique), F.lit("none")).alias("techniques"))
    detections = cited("seed", 0, "alert_id", "technique").union(cited("k % 3 = 0", 1, "'sum-' || user_id", "'T1078'")).union(cited("seed", 2, "alert_id", "'T1078'"))
    found = typed.with_detections(typed.normalized(docs), detections)
    return found.select("event_id", F.array_join("detection_id", ",").alias("alerts"), F.array_join("technique", ",").alias("techniques"))


def _json(parts: dict[str, str]) -> str:
    """SQL of a JSON object of texts that need no escapes; keys in order, nulls left out. Values that begin with '=' are JSON already."""
    one = lambda n, v: f"'\"{n}\":' || {v[1:]}" if v.startswith("=") else f"'\"{n}\":\"' || {v} || '\"'"
    return "'{' || concat_ws(',', " + ", ".join(one(n, v) for n, v in sorted(parts.items())) + ") || '}'"


#: Names as the twin expects them: who is a person is known in all texts of that user, as are their account and keys.
_PERSON = "(identity_type IS NULL OR identity_type IN ('IAMUser', 'AWSAccount'))"
_SAFE = "CASE WHEN named THEN 'USER_001' ELSE username END"
_CLOUDY = {"account": "'AWS_ACCOUNT_001'", "api_call": "action", "service": "'iam.test'", "identity_type": "identity_type", "access_key": "'ACCESS_KEY_001'", "mfa": "=CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END", "minted_access_key": "CASE WHEN action = 'AssumeRole' THEN 'ACCESS_KEY_002' END"}
_CLOUDY["principal"] = "replace(replace(principal_arn, account, 'AWS_ACCOUNT_001'), '/User' || user_id, CASE WHEN named AND username <> 'SYSTEM' THEN '/USER_001' ELSE '/User' || user_id END)"
_CLOUDY["resources"] = "=('[\"' || resource || '\",\"r1\",\"r2\",\"r1\",\"r3\"]')"
_CLOUDY["params"] = "=('{\"bucketName\":\"' || resource || '\",\"groupId\":' || k || ',\"password\":\"[REDACTED_SECRET_FIELD]\",\"roleArn\":\"role-' || (k % 9) || '\",\"userName\":\"USER_001\"}')"
_SHOWN = {"category": "kind", "action": "CASE WHEN kind = 'cloud' THEN 'api_call' ELSE action END", "outcome": "outcome", "severity": "level", "source": "source", "host": "CASE WHEN kind <> 'cloud' THEN coalesce(hostname, 'H') END", "source_ip": "source_ip", "actor": f"CASE WHEN {_PERSON} THEN 'USER_001' ELSE username END"}
_SHOWN |= {"destination": "(destination_ip || ':' || destination_port)", "domain": "CASE WHEN kind = 'dns' THEN 'host' || k || '.example.test' END", "vendor_rule": "rule_id"}
_SHOWN |= {n: f"CASE WHEN kind = 'process' THEN {v} END" for n, v in (("process", "process"), ("parent_process", "parent_process"), ("file_hash", "'h' || k"))}
_SHOWN |= {n: ("=" if v[0] == "=" else "") + _CLOUD.format(v.removeprefix("=")) for n, v in _CLOUDY.items()}
_FREE = {"command_line": _TOLD.format("(CASE WHEN length(line) > 240 THEN left(line, 239) || '…' ELSE line END)"), "user_agent": _CLOUD.format("'cli token=[REDACTED_SECRET_ASSIGNMENT]'"), "role_description": _CLOUD.format(f"'run by ' || {_SAFE}"), "vendor_rule_name": f"CASE WHEN kind = 'alert' THEN 'Rule seen for ' || {_SAFE} END"}


@twin(f"""WITH {_DOC}, n AS (SELECT *, bool_or({_PERSON} OR kind = 'cloud') OVER (PARTITION BY user_id) AS named, outcome AS o FROM d), l AS (SELECT *, 'tool --password [REDACTED_CLI_PASSWORD] for ' || {_SAFE} || ' ' || {_PAD} AS line FROM (SELECT * REPLACE (CASE WHEN pos % 97 = 0 THEN 'maybe' ELSE outcome END AS outcome) FROM n))
  SELECT pos, {_json(_SHOWN)} AS fields, {_json(_FREE)} AS untrusted FROM l""")
def item_fields(spark, sf_dir):
    """What context items show of event documents: structured fields and clipped free text, redacted by user."""
    return typed.item_fields(_documents(spark, sf_dir), "pos", "user_id").select("pos", "fields", "untrusted")
