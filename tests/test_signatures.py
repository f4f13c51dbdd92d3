"""Row rules and normalization on small fixtures, each row with its expected alerts."""

import json

import pytest

from cinderlake.operators import signatures

J = json.dumps
ADMIN = J({"Statement": {"Effect": "Allow", "Action": "*", "Resource": "*"}})
IAM = J({"Statement": [{"Effect": "Allow", "Action": ["s3:Get", "iam:*"], "Resource": ["*"]}]})
READ = J({"Statement": [{"Effect": "Allow", "Action": "s3:Get", "Resource": "*"}, {"Effect": "Deny", "Action": "*", "Resource": "*"}]})
cloud = lambda api, **k: {"category": "cloud", "api": api, "outcome": "success", **k}
shell = lambda command: {"category": "process", "process": r"C:\PowerShell.exe", "command_line": command}
opened = lambda **k: cloud("AuthorizeSecurityGroupIngress", params=J({"ipPermissions": [k]}))
flow = lambda ip, port=22: {"category": "network", "direction": "inbound", "flow_action": "ACCEPT", "source_ip": ip, "destination_port": port}
finding = lambda s: {"category": "alert", "vendor": "aws-guardduty", "finding_severity": s, "finding_type": "x"}
CASES = [
    ({}, []),
    (shell("powershell -NoP -w hidden"), [("SOC-EXEC-001", "high", "-nop, -w hidden")]),
    (shell("powershell"), []),
    (shell("x -Enc QUJDREVGR0hJSktMTU5P"), [("SOC-EXEC-002", "high", "20 QUJDREVGR0hJSktM")]),
    ({"category": "process", "parent_process": "WINWORD.EXE", "process": "cmd.exe"}, [("SOC-EXEC-003", "high", "winword.exe > cmd.exe")]),
    ({"category": "dns", "domain": "a8f3k2m9x7q1z5.example"}, [("SOC-DNS-001", "medium", "a8f3k2m9x7q1z5")]),
    ({"category": "dns", "domain": "aaaaaaaaaaaaaa.example"}, []),
    ({"category": "other", "raw": "read LSASS memory"}, [("SOC-CRED-001", "critical", "lsass")]),
    (cloud("ConsoleLogin", identity_type="Root", mfa=False, username="r"), [("CLOUD-AUTH-001", "high", "r"), ("CLOUD-ROOT-001", "high", "ConsoleLogin")]),
    (cloud("ConsoleLogin", mfa=None), []),
    (cloud("AssumeRole", principal_arn="arn:aws:iam::111:user/a", params=J({"roleArn": "arn:aws:iam::222:role/b"}), source_ip="8.8.8.8"), [("CLOUD-IAM-001", "medium", "cross-account, external-source")]),
    (cloud("AssumeRole", identity_type="AWSService", source_ip="8.8.8.8"), []),
    (cloud("AssumeRole", source_ip="ec2.amazonaws.com"), []),
    (cloud("AttachRolePolicy", params=J({"policyArn": "arn:aws:iam::aws:policy/AdministratorAccess"})), [("CLOUD-IAM-002", "high", "arn:aws:iam::aws:policy/AdministratorAccess")]),
    (cloud("PutUserPolicy", params=J({"policyDocument": ADMIN})), [("CLOUD-IAM-002", "high", "PutUserPolicy")]),
    (cloud("PutUserPolicy", params=J({"policyDocument": IAM})), [("CLOUD-IAM-002", "high", "PutUserPolicy")]),
    (cloud("PutUserPolicy", params=J({"policyDocument": json.loads(IAM)})), [("CLOUD-IAM-002", "high", "PutUserPolicy")]),
    (cloud("PutUserPolicy", params=J({"policyDocument": READ})), []),
    (cloud("PutUserPolicy", params=J({"policyDocument": "{broken"})), [("CLOUD-IAM-002", "high", "PutUserPolicy")]),
    (cloud("PutUserPolicy", params=J({"policyDocument": "{}"})), []),
    (cloud("PutUserPolicy"), [("CLOUD-IAM-002", "high", "PutUserPolicy")]),
    (cloud("CreatePolicyVersion", params=J({"policyDocument": ADMIN})), []),
    (cloud("CreatePolicyVersion", params=J({"policyDocument": ADMIN, "setAsDefault": True})), [("CLOUD-IAM-002", "high", "CreatePolicyVersion")]),
    (cloud("CreateAccessKey", username="a", params=J({"userName": "b"})), [("CLOUD-IAM-003", "high", "b")]),
    (cloud("CreateAccessKey", username="a"), []),
    (opened(cidrIp="0.0.0.0/0", ipProtocol="tcp", fromPort=20, toPort=23), [("CLOUD-NET-001", "high", "22, 23")]),
    (opened(cidrIpv6="::/0", ipProtocol="-1"), [("CLOUD-NET-001", "high", "ALL")]),
    (opened(cidrIp="0.0.0.0/0", ipProtocol="tcp", fromPort=443, toPort=443), []),
    (opened(cidrIp="10.0.0.0/8", ipProtocol="-1"), []),
    (flow("203.0.113.9"), [("CLOUD-NET-002", "high", "203.0.113.9:22")]),
    (flow("192.168.1.1"), []),
    (flow("203.0.113.9", 443), []),
    (cloud("StopLogging"), [("CLOUD-LOG-001", "critical", "StopLogging")]),
    (cloud("UpdateTrail") | {"outcome": "failure"}, [("CLOUD-LOG-001", "medium", "UpdateTrail")]),
    (finding(9.5), [("CLOUD-GD-001", "critical", "x")]),
    (finding(7.0), [("CLOUD-GD-001", "high", "x")]),
    (finding(6.9), []),
]


@pytest.fixture(scope="module")
def found(spark):
    schema = ", ".join(f"{c} {dict(destination_port='int', mfa='boolean', finding_severity='double').get(c, 'string')}" for c in signatures.COLUMNS) + ", extra int"
    rows = [[row.get(c) if c != "event_id" else f"e{i}" for c in signatures.COLUMNS] + [1] for i, (row, _) in enumerate(CASES)]
    out = {}
    for r in signatures.alerts(spark.createDataFrame(rows, schema)).collect():
        assert r.alert_id == f"alert-{r.rule_id}-{r.event_id}"
        out.setdefault(r.event_id, []).append((r.rule_id, r.severity, r.detail))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(found, i):
    assert sorted(found.get(f"e{i}", [])) == CASES[i][1]


def test_empty_and_narrow(spark):
    assert signatures.alerts(spark.createDataFrame([], "event_id string, category string")).count() == 0
