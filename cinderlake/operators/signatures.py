"""Row-signature rules: one alert per row that matches, all rules in one pass over the table.

Rules read the columns of COLUMNS; `params` and `response` are JSON objects as text. A null column matches nothing
unless a rule says otherwise. A rule is a detail column that is null where the rule doesn't match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.functions.text import INSIDE_PREFIXES, entropy

COLUMNS = ["event_id", "category", "action", "outcome", "process", "parent_process", "command_line", "domain", "raw", "rule_name", "api", "username", "identity_type", "principal_arn", "source_ip", "destination_port", "direction", "flow_action", "mfa", "vendor", "finding_type", "finding_severity", "params", "response"]

#: Fixed values of the rules.
SHELL_FLAGS = ["-nop", "-noprofile", "-w hidden", "-windowstyle hidden", "-ep bypass", "-executionpolicy bypass", "downloadstring", "invoke-expression", "iex ", "frombase64string"]
ENCODED = r"(?i)(?:^|\s)-(?:e|en|enc|encodedcommand)\s+([A-Za-z0-9+/=]{16,})"
LINEAGE = {
    "winword.exe": ["powershell.exe", "cmd.exe", "wscript.exe", "mshta.exe"],
    "excel.exe": ["powershell.exe", "cmd.exe", "wscript.exe", "mshta.exe"],
    "outlook.exe": ["powershell.exe", "cmd.exe", "wscript.exe"],
    "powershell.exe": ["rundll32.exe", "regsvr32.exe", "mshta.exe"],
    "w3wp.exe": ["cmd.exe", "powershell.exe"],
}
CREDENTIAL_MARKERS = ["lsass", "credential_access", "credential dumping", "sekurlsa"]
SENSITIVE_PORTS = [22, 23, 1433, 2375, 3306, 3389, 5432, 6379, 9200, 27017]
ATTACH_APIS = ["AttachUserPolicy", "AttachRolePolicy", "AttachGroupPolicy"]
INLINE_APIS = ["PutUserPolicy", "PutRolePolicy", "PutGroupPolicy", "CreatePolicyVersion"]
INGRESS_APIS = ["AuthorizeSecurityGroupIngress", "ModifySecurityGroupRules"]
LOG_STOP_APIS = ["StopLogging", "DeleteTrail", "DeleteFlowLogs"]
LOG_CHANGE_APIS = ["UpdateTrail", "PutEventSelectors"]
FINDING_HIGH, FINDING_CRITICAL = 7.0, 9.0
PERMISSIONS = "array<struct<cidrIp string, cidrIpv6 string, ipProtocol string, fromPort string, toPort string>>"


@dataclass
class Rule:
    rule_id: str
    severity: Column
    confidence: str
    detail: Column


def hits(text: Column, words: list[str]) -> Column:
    """Comma-joined words that the text has, in the given order; null for none."""
    found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def outside(address: Column) -> Column:
    """An address with a digit, of no inside prefix and no service host; false for null."""
    inside = F.lit(False)
    for prefix in INSIDE_PREFIXES:
        inside = inside | address.startswith(prefix)
    return F.coalesce(address.rlike("[0-9]") & ~inside & ~F.contains(address, F.lit("amazonaws.com")), F.lit(False))


def account_of(arn: Column) -> Column:
    """The fifth part of an ARN; null if there is none."""
    return F.nullif(F.when(arn.startswith("arn:"), F.split_part(arn, F.lit(":"), F.lit(5))), F.lit(""))


def json_list(text: Column) -> Column:
    """A JSON list of texts as an array, a bare text as an array of one, anything else as an empty array."""
    listed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(text))


def grants_all(document: Column) -> Column:
    """Whether a policy allows every action (or all of iam) on every resource; one that can't be read counts as granting."""
    statement = F.get_json_object(document, "$.Statement")
    listed = F.when(statement.startswith("["), F.from_json(statement, "array<string>")).when(statement.startswith("{"), F.array(statement))
    one = lambda s: (F.get_json_object(s, "$.Effect") == "Allow") & F.arrays_overlap(json_list(F.get_json_object(s, "$.Action")), F.array(F.lit("*"), F.lit("iam:*"))) & F.array_contains(json_list(F.get_json_object(s, "$.Resource")), "*")
    wrong = document.isNull() | ~F.ltrim(document).startswith("{") | F.try_parse_json(document).isNull()
    return F.when(wrong, True).when(statement.isNull(), False).when(listed.isNull(), True).otherwise(F.coalesce(F.exists(listed, lambda s: F.coalesce(one(s), F.lit(False))), F.lit(False)))


def exposed_ports(params: Column) -> Column:
    """Comma-joined sensitive ports (or ALL) that any permission opens to every address; null for none."""
    ports = F.array(*[F.lit(p) for p in SENSITIVE_PORTS])
    reached = lambda p: F.filter(ports, lambda n: (n >= p["fromPort"].try_cast("int")) & (n <= p["toPort"].try_cast("int")))
    opened = lambda p: (p["cidrIp"] == "0.0.0.0/0") | (p["cidrIpv6"] == "::/0")
    found = F.flatten(F.transform(F.filter(F.from_json(F.get_json_object(params, "$.ipPermissions"), PERMISSIONS), opened), lambda p: F.when(p["ipProtocol"] == "-1", F.array(F.lit("ALL"))).otherwise(F.coalesce(reached(p).cast("array<string>"), F.array().cast("array<string>")))))
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def rules() -> list[Rule]:
    c, low = F.col, lambda name: F.lower(F.col(name))
    param = lambda name: F.get_json_object("params", f"$.{name}")
    when = lambda cond, detail: F.when(cond, F.coalesce(detail.cast("string"), F.lit("unknown")))
    api = lambda names: (c("category") == "cloud") & c("api").isin(names)
    done, shell = c("outcome") == "success", (c("category") == "process") & F.contains(low("process"), F.lit("powershell"))
    payload, label = F.regexp_extract(F.coalesce("command_line", F.lit("")), ENCODED, 1), F.split_part("domain", F.lit("."), F.lit(1))
    flags = hits(low("command_line"), SHELL_FLAGS)
    marks = hits(F.concat_ws(" ", low("action"), low("raw"), low("rule_name")), CREDENTIAL_MARKERS)
    child = F.coalesce(*[F.when(low("parent_process") == p, low("process").isin(kids)) for p, kids in LINEAGE.items()])
    caller, owner = account_of(c("principal_arn")), account_of(param("roleArn"))
    why = F.array_join(F.array_compact(F.array(F.when(caller != owner, "cross-account"), F.when(c("identity_type") == "AssumedRole", "role-chaining"), F.when(outside(c("source_ip")), "external-source"))), ", ")
    policy, creator = param("policyArn"), F.coalesce("username", F.lit("unknown"))
    admin = policy.endswith(":policy/AdministratorAccess") | policy.endswith(":policy/IAMFullAccess")
    default = (c("api") != "CreatePolicyVersion") | F.coalesce(param("setAsDefault") == "true", F.lit(False))
    target = F.coalesce(F.nullif(param("userName"), F.lit("")), creator)
    grade = lambda test, yes, no: F.when(test, yes).otherwise(no)
    return [
        Rule("SOC-EXEC-001", F.lit("high"), "medium", F.when(shell, flags)),
        Rule("SOC-EXEC-002", F.lit("high"), "high", when(shell & (payload != ""), F.concat_ws(" ", F.length(payload).cast("string"), F.substring(payload, 1, 16)))),
        Rule("SOC-EXEC-003", F.lit("high"), "medium", when((c("category") == "process") & child, F.concat_ws(" > ", low("parent_process"), low("process")))),
        Rule("SOC-DNS-001", F.lit("medium"), "low", when((c("category") == "dns") & (F.length(label) >= 12) & (entropy(label) >= 3.2), label)),
        Rule("SOC-CRED-001", F.lit("critical"), "high", marks),
        Rule("CLOUD-ROOT-001", F.lit("high"), "high", when((c("category") == "cloud") & (c("identity_type") == "Root"), c("api"))),
        Rule("CLOUD-AUTH-001", F.lit("high"), "high", when(api(["ConsoleLogin"]) & done & (c("mfa") == F.lit(False)), c("username"))),
        Rule("CLOUD-IAM-001", F.lit("medium"), "medium", F.when(api(["AssumeRole"]) & done & ~c("identity_type").eqNullSafe("AWSService") & (why != ""), why)),
        Rule("CLOUD-IAM-002", F.lit("high"), "high", when(done & (api(ATTACH_APIS) & admin | api(INLINE_APIS) & default & grants_all(param("policyDocument"))), F.coalesce(policy, c("api")))),
        Rule("CLOUD-IAM-003", F.lit("high"), "high", when(api(["CreateAccessKey"]) & done & ((target != creator) | c("identity_type").eqNullSafe("Root")), target)),
        Rule("CLOUD-NET-001", F.lit("high"), "high", F.when(api(INGRESS_APIS) & done, exposed_ports(c("params")))),
        Rule("CLOUD-NET-002", F.lit("high"), "medium", when((c("category") == "network") & (c("direction") == "inbound") & (c("flow_action") == "ACCEPT") & c("destination_port").isin(SENSITIVE_PORTS) & outside(c("source_ip")), F.concat_ws(":", "source_ip", c("destination_port").cast("string")))),
        Rule("CLOUD-LOG-001", grade(c("api").isin(LOG_STOP_APIS), "critical", "medium"), "high", when(api(LOG_STOP_APIS + LOG_CHANGE_APIS), c("api"))),
        Rule("CLOUD-GD-001", grade(c("finding_severity") >= FINDING_CRITICAL, "critical", "high"), "medium", when((c("category") == "alert") & (c("vendor") == "aws-guardduty") & (c("finding_severity") >= FINDING_HIGH), c("finding_type"))),
    ]


def alerts(rows: DataFrame) -> DataFrame:
    """(alert_id, rule_id, event_id, severity, confidence, detail) of every rule and row that match.

    Columns of COLUMNS that rows lacks count as null; further columns are ignored. No shuffle: a projection and an
    explode. An empty table gives no alerts, repeated rows give repeated alerts."""
    types = {"destination_port": "int", "mfa": "boolean", "finding_severity": "double"}
    full = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(types.get(n, "string")).alias(n) for n in COLUMNS])
    found = [F.when(r.detail.isNotNull(), F.struct(F.lit(r.rule_id).alias("rule_id"), r.severity.alias("severity"), F.lit(r.confidence).alias("confidence"), r.detail.alias("detail"))) for r in rules()]
    hit = full.select("event_id", F.explode(F.array_compact(F.array(*found))).alias("a"))
    return hit.select(F.concat(F.lit("alert-"), "a.rule_id", F.lit("-"), "event_id").alias("alert_id"), "event_id", "a.*")
