"""Threshold rules, baseline signals, and incidents built from alerts, with their risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions import text as X
from cinderlake.operators import windows
from cinderlake.operators.evidence import BANDS, SEVERITY_POINTS
from cinderlake.operators.graph import connected_components
from cinderlake.plans.buckets import DAY, bucket_of, carried, same_bucket
from cinderlake.plans.hot import join_hot
from cinderlake.plans.stored import materialize, numbered

#: Tactics in kill-chain order, and each technique with its name and tactic.
TACTICS = ["Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact"]
TECHNIQUES = {
    "T1078": ("Valid Accounts", "Initial Access"), "T1110": ("Brute Force", "Credential Access"), "T1110.003": ("Password Spraying", "Credential Access"),
    "T1621": ("Multi-Factor Authentication Request Generation", "Credential Access"), "T1059": ("Command and Scripting Interpreter", "Execution"), "T1059.001": ("PowerShell", "Execution"),
    "T1027": ("Obfuscated Files or Information", "Defense Evasion"), "T1027.010": ("Command Obfuscation", "Defense Evasion"), "T1218": ("System Binary Proxy Execution", "Defense Evasion"),
    "T1218.011": ("Rundll32", "Defense Evasion"), "T1204": ("User Execution", "Execution"), "T1204.002": ("Malicious File", "Execution"), "T1003": ("OS Credential Dumping", "Credential Access"),
    "T1003.001": ("LSASS Memory", "Credential Access"), "T1071": ("Application Layer Protocol", "Command and Control"), "T1071.001": ("Web Protocols", "Command and Control"),
    "T1568": ("Dynamic Resolution", "Command and Control"), "T1568.002": ("Domain Generation Algorithms", "Command and Control"), "T1041": ("Exfiltration Over C2 Channel", "Exfiltration"),
    "T1530": ("Data from Cloud Storage", "Collection"), "T1547": ("Boot or Logon Autostart Execution", "Persistence"), "T1547.001": ("Registry Run Keys / Startup Folder", "Persistence"),
    "T1021": ("Remote Services", "Lateral Movement"), "T1021.002": ("SMB/Windows Admin Shares", "Lateral Movement"), "T1087": ("Account Discovery", "Discovery"),
    "T1140": ("Deobfuscate/Decode Files or Information", "Defense Evasion"), "T1078.004": ("Cloud Accounts", "Initial Access"), "T1098": ("Account Manipulation", "Persistence"),
    "T1098.001": ("Additional Cloud Credentials", "Persistence"), "T1098.003": ("Additional Cloud Roles", "Persistence"), "T1562": ("Impair Defenses", "Defense Evasion"),
    "T1562.007": ("Disable or Modify Cloud Firewall", "Defense Evasion"), "T1562.008": ("Disable or Modify Cloud Logs", "Defense Evasion"), "T1580": ("Cloud Infrastructure Discovery", "Discovery"),
}
#: Names of denied second factors, read calls, discovery prefixes, and seconds between related alerts.
MFA_ACTIONS, READ_CALLS, DISCOVERY, RELATED_SECONDS = ["mfa_denied", "mfa_bypass_attempt", "mfa_push_denied"], ["GetObject", "CopyObject"], ["List", "Describe", "Get"], 4 * 3600
#: Points of the risk factors and the tactics of the kill-chain ones.
PER_ALERT, MOST_ALERTS, HIGH_CONFIDENCE, MANY_HOSTS, IMPAIRED, PRIVILEGED = 4, 16, 4, 6, 14, 14
KILL_CHAIN = {
    "credential_activity": (18, ["Credential Access"]), "execution_activity": (10, ["Execution"]), "persistence_indicators": (10, ["Persistence", "Privilege Escalation"]),
    "lateral_movement": (12, ["Lateral Movement"]), "c2_indicators": (14, ["Command and Control"]), "sensitive_access": (10, ["Collection", "Exfiltration", "Impact"]),
}
SENSITIVE_ACTIONS = ["admin_share_access", "anomalous_api_usage", "data_from_cloud_storage"]


def tactic_of(technique: Column) -> Column:
    """Tactic of a technique id; null if it isn't known."""
    return F.element_at(F.create_map(*[F.lit(x) for k, (_, t) in TECHNIQUES.items() for x in (k, t)]), technique)


def described(technique: Column) -> Column:
    """A technique as 'id (name, tactic)'; the bare id if it isn't known."""
    known = F.create_map(*[F.lit(x) for k, (n, t) in TECHNIQUES.items() for x in (k, f"{k} ({n}, {t})")])
    return F.coalesce(F.element_at(known, technique), technique)


def outside(address: Column) -> Column:
    """Whether an address with a digit is none of the inside prefixes, nor a service's host name."""
    return F.coalesce(~X.inside_by_prefix(address) & address.rlike("[0-9]") & ~F.contains(address, F.lit("amazonaws.com")), F.lit(False))


def principal() -> Column:
    """Who acts in the cloud: the identity's name or else the user."""
    return F.coalesce(F.nullif("principal_arn", F.lit("")), F.nullif("username", F.lit("")))


def threshold_rules() -> dict[str, tuple[Column, Column, Column | None, int, int]]:
    """rule: (which events qualify, key, distinct value or None, least number, seconds)."""
    c = F.col
    mfa = F.lower("action").contains("mfa")
    cloud = (c("category") == "cloud") & outside(c("source_ip"))
    return {
        "SOC-AUTH-001": ((c("category") == "authentication") & (c("outcome") == "failure") & ~mfa, c("source_ip"), c("username"), 3, 300),
        "SOC-AUTH-002": ((c("category") == "authentication") & c("action").isin(MFA_ACTIONS), c("username"), None, 3, 600),
        "SOC-NET-001": ((c("category") == "network") & (c("direction") == "outbound") & ~X.inside_by_prefix(c("destination_ip")), F.concat("hostname", F.lit("->"), "destination_ip"), None, 2, 3600),
        "CLOUD-S3-001": (cloud & c("action").isin(READ_CALLS) & c("sensitive"), F.concat(principal(), F.lit("@"), "resource"), None, 3, 600),
        "CLOUD-API-001": (cloud & ~c("identity_type").eqNullSafe("AWSService") & reduce(lambda a, b: a | b, [c("action").startswith(p) for p in DISCOVERY]) & ~c("action").isin(READ_CALLS), principal(), c("action"), 5, 300),
    }


def threshold_alerts(events: DataFrame, rule: str, stretch: int = 1) -> DataFrame:
    """Alerts of one threshold rule; stretch widens its window, for sparse data."""
    qualifies, key, distinct, n, seconds = threshold_rules()[rule]
    rows = events.where(qualifies).select(key.alias("key"), "t", "pos", *([distinct.alias("d")] if distinct is not None else [])).where("key is not null")
    return windows.threshold(rows, n, seconds * stretch, distinct=distinct is not None)


def external_sources(events: DataFrame) -> DataFrame:
    """(ip, n, first_pos): source addresses outside private networks, with their events.

    Addresses are judged once each, not once an event: the judged one is an aggregate, so that no filter moves below the grouping."""
    octets = F.split("ip", r"\.")
    seen = events.where("source_ip is not null").groupBy("source_ip").agg(F.max("source_ip").alias("ip"), F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return seen.where(~X.inside_by_network(X.address_number([octets[i] for i in range(4)]))).select("ip", "n", "first_pos")


def baseline_signals(events: DataFrame, least: int = 5, seconds: int = 600, most: int = 2) -> DataFrame:
    """(place, signal, ip, n, first_pos): external sources, bursts of failed log-ons, successes after them, rare shapes.

    Kinds follow one another in this order, sources in theirs."""
    external = external_sources(events).select(F.lit(0).alias("kind"), F.lit("SIG-EXT-SRC").alias("signal"), "ip", "n", "first_pos")
    count = lambda rows, k, name: rows.groupBy("source_ip").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).select(F.lit(k).alias("kind"), F.lit(name).alias("signal"), F.col("source_ip").alias("ip"), "n", "first_pos")
    logons = events.where("category = 'authentication' and source_ip is not null and t is not null")
    failed = logons.where("outcome = 'failure'").select(F.col("source_ip").alias("key"), "t", "pos")
    bursts = windows.burst(failed, least, seconds)
    cited = failed.join(bursts.select("key"), "key").withColumnRenamed("key", "source_ip")
    after = logons.where("outcome <> 'failure'").join(bursts.select(F.col("key").alias("source_ip"), "first_t"), "source_ip").where("t >= first_t")
    rare = windows.rare(events.select("pos", "category", "action", "process"), ["category", "action", "process"], most)
    odd = rare.agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).where("n > 0").select(F.lit(3).alias("kind"), F.lit("SIG-RARE-SHAPE").alias("signal"), F.lit(None).cast("string").alias("ip"), "n", "first_pos")
    found = external.union(count(cited, 1, "SIG-AUTH-BURST")).union(count(after, 2, "SIG-AUTH-SUCCESS-AFTER-BURST")).union(odd)
    return numbered(found, [F.asc("kind"), F.asc_nulls_first("ip")], "place").drop("kind")


def alerts_of(evidence: DataFrame) -> DataFrame:
    """Alerts from evidence(alert_id, rule_id, technique, pos, t, severity, confidence, entities): spans, severity, keys."""
    names = evidence.groupBy("alert_id", "rule_id", "technique", "confidence")
    return names.agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("severity").alias("severity"), F.min("pos").alias("first_pos"), F.count("*").alias("n_events"))


def related(evidence: DataFrame, alerts: DataFrame, seconds: int = RELATED_SECONDS) -> DataFrame:
    """(a, b) links enough to connect all alerts that share an entity or an event within `seconds` of their spans.

    Per key, alerts in time order link with the one before them that lasts longest: what a later one reaches, that one
    reaches. So links are fewer than alerts, however many share a key."""
    keys = evidence.select("alert_id", F.explode(F.concat("entities", F.array(F.concat(F.lit("event:"), F.col("pos").cast("string"))))).alias("key")).distinct()
    spans = keys.join(alerts.select("alert_id", "number", "first_t", "last_t").hint("merge"), "alert_id")
    before = Window.partitionBy("key").orderBy("first_t", "number").rowsBetween(Window.unboundedPreceding, -1)
    longest = F.max(F.struct("last_t", "number")).over(before)
    return spans.withColumn("p", longest).where(F.col("first_t") - F.col("p.last_t") <= seconds * 1_000_000).select(F.col("number").alias("a"), F.col("p.number").alias("b")).distinct()


def incidents_of(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with their incident, incidents numbered by their earliest evidence)."""
    alerts = materialize(numbered(alerts_of(evidence), [F.asc("first_t"), F.asc("alert_id")], "number"), "alerts")
    found = connected_components(related(evidence, alerts))
    owned = alerts.join(found, F.col("number") == F.col("node"), "left").withColumn("group", F.coalesce("component", "number")).drop("node", "component")
    groups = numbered(owned.groupBy("group").agg(F.min("first_t").alias("began")), [F.asc("began"), F.asc("group")], "place")
    owned = materialize(owned.join(groups.select("group", F.format_string("inc-%04d", "place").alias("incident_id")).hint("merge"), "group").drop("group"), "owned")
    return owned, materialize(rollup(owned, evidence), "incidents")


def first_seen(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, values): distinct non-empty values of each group in the order of their first appearance, comma-joined."""
    firsts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(by, value).agg(F.min(order).alias("o"))
    return firsts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]), ",").alias(f"{value}s"))


def with_incident(evidence: DataFrame, owned: DataFrame, *more: str) -> DataFrame:
    """Evidence with the incident of its alert. Alerts may be as many as evidence, and small in files: they aren't broadcast."""
    return evidence.join(owned.select("alert_id", "incident_id", *more).hint("merge"), "alert_id")


def rollup(owned: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per incident: severity, span, numbers, ordered distinct hosts, users and techniques, and a title."""
    lead = F.max(F.struct("severity", (-F.col("number")).alias("early"), "rule_id")).alias("lead")
    sums = owned.groupBy("incident_id").agg(F.count("*").alias("n_alerts"), F.countDistinct("rule_id").alias("n_rules"), F.max("severity").alias("severity"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), lead)
    cited = with_incident(evidence, owned, "number").withColumn("at", F.struct("t", "pos"))
    events = cited.groupBy("incident_id").agg(F.countDistinct("pos").alias("n_events"), F.countDistinct("hostname").alias("n_hosts"))
    out = sums.join(events, "incident_id")
    for value, order in (("hostname", "at"), ("username", "at"), ("source_ip", "at")):
        out = out.join(first_seen(cited, "incident_id", value, order), "incident_id", "left")
    out = out.join(first_seen(owned, "incident_id", "technique", "number"), "incident_id", "left")
    scope = F.when(F.col("n_hosts") == 1, F.col("hostnames")).otherwise(F.concat(F.col("n_hosts").cast("string"), F.lit(" hosts")))
    more = F.when(F.col("n_alerts") > 1, F.format_string(" and %d related alert(s)", F.col("n_alerts") - 1)).otherwise("")
    return out.withColumn("title", F.concat("lead.rule_id", more, F.lit(" on "), scope)).withColumn("lead_rule", F.col("lead.rule_id")).withColumn("duration", F.col("last_t") - F.col("first_t")).drop("lead")


def risk_factors(owned: DataFrame, incidents: DataFrame, evidence: DataFrame) -> DataFrame:
    """(incident_id, score, band, factors): the twelve itemized factors of each incident, those of 0 points left out."""
    tactic = tactic_of(F.col("technique"))
    alerts = owned.groupBy("incident_id").agg(
        *[F.coalesce(F.bool_or(tactic.isin(ts)), F.lit(False)).alias(name) for name, (_, ts) in KILL_CHAIN.items()],
        F.coalesce(F.bool_or(F.col("technique").startswith("T1562")), F.lit(False)).alias("impair_defenses"), F.bool_or(F.col("confidence") == "high").alias("detection_confidence"),
    )
    cited = evidence.join(owned.select("alert_id", "incident_id"), "alert_id").groupBy("incident_id").agg(F.bool_or(F.col("action").isin(SENSITIVE_ACTIONS)).alias("marked"), F.bool_or(F.col("identity_type").eqNullSafe("Root")).alias("privileged_identity"))
    all_ = incidents.join(alerts, "incident_id").join(cited, "incident_id")
    c, points = F.col, F.element_at(F.array(*[F.lit(p) for p in SEVERITY_POINTS.values()]), F.col("severity") + 1)
    items = {"alert_severity": points, "correlated_alerts": F.least(F.lit(MOST_ALERTS), PER_ALERT * (c("n_alerts") - 1)).cast("int")}
    items |= {name: F.when(c(name) | (c("marked") if name == "sensitive_access" else F.lit(False)), p).otherwise(0) for name, (p, _) in KILL_CHAIN.items()}
    items |= {"impair_defenses": F.when(c("impair_defenses"), IMPAIRED).otherwise(0), "privileged_identity": F.when(c("privileged_identity"), PRIVILEGED).otherwise(0), "multi_host": F.when(c("n_hosts") > 1, MANY_HOSTS).otherwise(0), "detection_confidence": F.when(c("detection_confidence"), HIGH_CONFIDENCE).otherwise(0)}
    kept = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("points")) for k, v in items.items()]), lambda f: f["points"] > 0)
    scored = all_.select("incident_id", kept.alias("f")).withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), F.aggregate("f", F.lit(0), lambda a, f: a + f["points"]))))
    band = reduce(lambda other, b: F.when(c("score") >= b[0], b[1]).otherwise(other), reversed(BANDS), F.lit("informational"))
    return scored.select("incident_id", "score", band.alias("band"), F.array_join(F.transform("f", lambda f: F.concat_ws("=", f["name"], f["points"].cast("string"))), ";").alias("factors"))


def technique_rollup(owned: DataFrame) -> DataFrame:
    """(technique, text, tactic, n_rules, n_alerts, n_events) of known techniques."""
    known = owned.where(tactic_of(F.col("technique")).isNotNull())
    summed = known.groupBy("technique").agg(F.countDistinct("rule_id").alias("n_rules"), F.count("*").alias("n_alerts"), F.sum("n_events").alias("n_events"))
    return summed.select("technique", described(F.col("technique")).alias("text"), tactic_of(F.col("technique")).alias("tactic"), F.substring_index("technique", ".", 1).alias("parent"), "n_rules", "n_alerts", "n_events")


def tactics_reached(owned: DataFrame) -> DataFrame:
    """(incident_id, tactics in kill-chain order, furthest)."""
    place = F.array_position(F.array(*map(F.lit, TACTICS)), tactic_of(F.col("technique"))).cast("int")
    seen = F.array_sort(F.collect_set(place))
    name = lambda p: F.element_at(F.array(*map(F.lit, TACTICS)), p)
    return owned.groupBy("incident_id").agg(seen.alias("s")).select("incident_id", F.array_join(F.transform("s", name), ",").alias("tactics"), F.when(F.size("s") > 0, name(F.array_max("s"))).alias("furthest"))


def relevant_events(events: DataFrame, incidents: DataFrame, owned: DataFrame, evidence: DataFrame, seconds: int = 1800) -> DataFrame:
    """(incident_id, pos, t): events that no alert of the incident cites, that share an entity with its evidence and lie
    within `seconds` of its span."""
    cited = evidence.join(owned.select("alert_id", "incident_id"), "alert_id").select("incident_id", "pos", "entities").dropDuplicates(["incident_id", "pos"])
    span = incidents.select("incident_id", (F.col("first_t") - seconds * 1_000_000).alias("lo"), (F.col("last_t") + seconds * 1_000_000).alias("hi"))
    wanted = cited.select("incident_id", F.explode("entities").alias("entity")).distinct().join(span, "incident_id")
    # Hours cut both sides of an entity into pieces that meet only where they can overlap in time.
    hour = 3600 * 1_000_000
    wanted = wanted.withColumn("h", F.explode(F.sequence(F.expr(f"lo div {hour}"), F.expr(f"hi div {hour}"))))
    have = events.select("pos", "t", F.explode_outer("entities").alias("entity")).where("entity is not null").withColumn("h", F.expr(f"t div {hour}"))
    near = have.join(wanted, ["entity", "h"]).where("t between lo and hi").select("incident_id", "pos", "t").distinct()
    return near.join(cited.select("incident_id", "pos"), ["incident_id", "pos"], "left_anti")


def surrounding(events: DataFrame, incidents: DataFrame, owned: DataFrame, evidence: DataFrame, seconds: int = 1800) -> DataFrame:
    """(pos) of events that any incident cites or that relevant_events() has for any; whose they are is left open.

    An event is near if of the spans of its entity that begin until then the last end isn't over. So events meet no spans: a running
    maximum in a day of an entity, and one carried to it from the days before, say it, however long a span is."""
    cited = with_incident(evidence, owned).select("incident_id", "pos", "entities")
    span = incidents.select("incident_id", (F.col("first_t") - seconds * 1_000_000).alias("lo"), (F.col("last_t") + seconds * 1_000_000).alias("hi"))
    wanted = cited.select("incident_id", F.explode("entities").alias("entity")).distinct().join(span, "incident_id").groupBy("entity", F.col("lo").alias("t")).agg(F.max("hi").alias("hi"))
    have = events.where("t is not null").select("pos", "t", F.explode("entities").alias("entity")).where("entity is not null")
    rows = have.select("entity", "t", "pos", F.lit(None).cast("long").alias("hi")).union(wanted.select("entity", "t", F.lit(None).cast("long"), "hi"))
    rows = rows.withColumn("bucket", bucket_of(F.col("t"), DAY))
    days = carried(rows, "entity", {"hi": F.max("hi")}, {"earlier": (F.max("hi"), "before")}).where("earlier is not null")
    until = Window.partitionBy("entity", "bucket").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumn("here", F.max("hi").over(until)).where("pos is not null")
    near = here.join(days.hint("merge"), same_bucket("entity"), "left").where("t <= here or t <= earlier").select("pos")
    return near.union(cited.select("pos")).distinct()


def details(owned: DataFrame, incidents: DataFrame, evidence: DataFrame, risk: DataFrame) -> dict[str, DataFrame]:
    """What one sees of an incident, as frames of (incident_id, o1, o2, item), item a JSON object; o1 and o2 are their order.

    incident: title, severity, span and numbers; risk; alert: by severity, rule and id; chain: alerts by first evidence, with tactics;
    mitre: techniques with their rules and alerts; timeline: cited events in time; entity: names without their kind.
    Rows, not lists: an incident with a third of all alerts is many rows, never one."""
    c, text = F.col, lambda n: F.lpad(F.col(n).cast("string"), 19, "0")
    said = lambda *names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("item")
    shown = lambda rows, o1, o2, *names: rows.select("incident_id", o1.cast("long").alias("o1"), o2.alias("o2"), said(*names))
    cited = evidence.join(owned.select("alert_id", "incident_id"), "alert_id")
    events = cited.groupBy("incident_id", "pos").agg(*[F.min(n).alias(n) for n in ("t", "event_id", "action", "outcome")], F.count("*").alias("n_alerts"))
    used = owned.where("technique is not null").groupBy("incident_id", "technique").agg(F.countDistinct("rule_id").alias("n_rules"), F.count("*").alias("n_alerts"))
    names = cited.select("incident_id", F.explode("entities").alias("e")).select("incident_id", F.regexp_replace("e", "^[a-z]+:", "").alias("value")).distinct()
    one, none = F.lit(0), F.lit("")
    return {
        "incident": shown(incidents, one, none, "title", "severity", "first_t", "last_t", "n_alerts", "n_events", "n_hosts"),
        "risk": shown(risk, one, none, "score", "band", "factors"),
        "alert": shown(owned, -c("severity"), F.concat_ws(" ", "rule_id", "alert_id"), "alert_id", "rule_id", "severity", "first_t", "n_events"),
        "chain": shown(owned.withColumn("tactic", tactic_of(c("technique"))), c("first_t"), text("number"), "alert_id", "technique", "tactic"),
        "mitre": shown(used, one, c("technique"), "technique", "n_rules", "n_alerts"),
        "timeline": shown(events, c("t"), text("pos"), "event_id", "action", "outcome", "n_alerts"),
        "entity": shown(names, one, c("value"), "value"),
    }


def bundle(frames: dict[str, DataFrame]) -> DataFrame:
    """(incident_id, section, place, item) of details(); place counts from 1 in each section of an incident.

    All rows are numbered at once by range partitions, so a hot incident isn't one task."""
    rows = reduce(DataFrame.union, [f.select("incident_id", F.lit(n).alias("section"), "o1", "o2", "item") for n, f in frames.items()])
    placed = materialize(numbered(rows, [F.asc("incident_id"), F.asc("section"), F.asc("o1"), F.asc("o2")], "n").withColumn("key", F.concat_ws(" ", "incident_id", "section")), "bundle")
    firsts = placed.groupBy("key").agg(F.min("n").alias("first"))
    return join_hot(placed, firsts, "key").select("incident_id", "section", (F.col("n") - F.col("first") + 1).alias("place"), "item")


def unify(*frames: DataFrame) -> DataFrame:
    """All rows of several datasets, whatever columns each lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

