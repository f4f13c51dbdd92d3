"""Security telemetry bound to the raw events table: the columns that detections, incidents and context packs expect.

The mapping is a binding for tables without such columns; TELEMETRY_SQL says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.sources.tables import MICROS, table

APIS = ["ListUsers", "DescribeInstances", "GetObject", "AssumeRole", "GetCallerIdentity", "ListBuckets", "GetPolicy", "CopyObject"]
TECHNIQUES_OF_RULES = ["T1110.003", "T1059.001", "T1530", "T1562.008"]
SEVERITIES = ["informational", "low", "medium", "high", "critical"]

#: Columns in order; {u}, {k} and {day} stand for the user, the number in props and the day of the event.
_COLUMNS = {
    "event_id": "'ev-' || {pos}",
    "category": "CASE event_type WHEN 'error' THEN 'authentication' WHEN 'purchase' THEN 'alert' WHEN 'click' THEN 'network' WHEN 'signup' THEN 'cloud' ELSE 'process' END",
    "action": "CASE event_type WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 'mfa_denied' WHEN k % 3 = 1 THEN 'logon_failed' ELSE 'logon' END WHEN 'purchase' THEN CASE WHEN k % 10 = 0 THEN 'admin_share_access' ELSE 'alert_raised' END WHEN 'click' THEN 'connect' WHEN 'signup' THEN " + "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(APIS)) + " END ELSE 'process_start' END",
    "outcome": "CASE WHEN event_type = 'error' THEN CASE WHEN k % 4 = 3 THEN 'success' ELSE 'failure' END WHEN k % 7 = 0 THEN 'blocked' ELSE 'success' END",
    "username": "CASE WHEN user_id % 50 = 0 THEN 'SYSTEM' ELSE 'User' || user_id END",
    "hostname": "CASE WHEN event_type <> 'signup' THEN 'HOST-' || (k % 40) END",
    "source_ip": "CASE WHEN k % 10 = 0 THEN '10.0.0.' ELSE '203.0.113.' END || (user_id % 40)",
    "destination_ip": "CASE WHEN event_type = 'click' THEN CASE WHEN k % 3 = 0 THEN '192.168.1.' || k ELSE '198.51.100.' || (k % 20) END END",
    "destination_port": "CASE WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 22 ELSE 443 END END",
    "direction": "CASE WHEN event_type = 'click' THEN CASE WHEN k % 5 = 0 THEN 'inbound' ELSE 'outbound' END END",
    "process": "CASE WHEN event_type IN ('view', 'purchase') THEN 'Proc' || (k % 50) || '.exe' END",
    "parent_process": "CASE WHEN event_type = 'view' THEN 'parent' || (k % 7) || '.exe' END",
    "account": "CASE WHEN event_type = 'signup' THEN '1111222' || (10000 + user_id % 100) END",
    "resource": "CASE WHEN event_type = 'signup' THEN 'bucket-' || (CASE WHEN k % 2 = 0 THEN user_id ELSE k END % 60) END",
    "identity_type": "CASE WHEN event_type = 'signup' THEN CASE k % 9 WHEN 0 THEN 'Root' WHEN 1 THEN 'AWSService' ELSE 'IAMUser' END END",
    "principal_arn": "CASE WHEN event_type = 'signup' THEN 'arn:aws:iam::1111222' || (10000 + user_id % 100) || ':user/User' || user_id END",
    "source": "'src' || (k % 3)",
    "alert_id": "CASE WHEN event_type = 'purchase' THEN 'a-' || user_id || '-' || (k % 4) || '-' || {day} END",
    "rule_id": "CASE WHEN event_type = 'purchase' THEN 'RULE-' || (k % 4) END",
    "technique": "CASE WHEN event_type = 'purchase' THEN CASE k % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TECHNIQUES_OF_RULES)) + " END END",
}

TELEMETRY_SQL = "sec AS (SELECT pos, t, seed, severity, user_id, k, " + ", ".join(f"{e.replace('{pos}', 'pos').replace('{day}', '(t // 86400000000 - 19723)')} AS {c}" for c, e in _COLUMNS.items()) + """ FROM
  (SELECT event_id AS pos, epoch_us(ts) AS t, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, event_type = 'purchase' AS seed, LEAST(4, GREATEST(0, CAST(floor(value / 25) AS INTEGER))) AS severity FROM events))"""


def telemetry(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The events with their columns; dealt, they are shuffled while they are small, for work that takes long for each."""
    raw = table(spark, sf_dir, "events")
    raw = raw.repartition("event_id") if dealt else raw
    # k is named behind inline(): filters pushed down would otherwise read props anew in every place where a column says k.
    read = raw.select("*", F.inline(F.array(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k")))))
    base = read.select(F.col("event_id").alias("pos"), F.expr(MICROS).alias("t"), "user_id", "k", "event_type", (F.col("event_type") == "purchase").alias("seed"), F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("value") / 25).cast("int"))).alias("severity"))
    columns = [F.expr(e.replace("{pos}", "pos").replace("{day}", "(t div 86400000000 - 19723)")).alias(c) for c, e in _COLUMNS.items()]
    return base.select("pos", "t", "seed", "severity", "user_id", "k", *columns)


def normalized(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """telemetry with the list columns of normalized events."""
    one = lambda c: F.array_compact(F.array(c))
    return telemetry(spark, sf_dir, dealt).select("*", F.col("category").alias("event_type"), F.col("outcome").alias("status"), one("resource").alias("resources"), one("alert_id").alias("detection_ids"), one("rule_id").alias("rule_ids"), one("technique").alias("techniques"))
