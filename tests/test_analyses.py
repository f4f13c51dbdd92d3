"""Every check of an analysis by a faulty document of its own, documents of other shapes, and citations."""

import json

from pyspark.sql import functions as F

from cinderlake.operators import analyses

SOUND = {
    "incident_id": "inc-1", "summary": "No action has been taken.", "evidence": [{"event_ids": ["e1", "e2"]}], "technique_ids": ["T1003"], "confidence": "low", "proposed_only": True,
    "recommended_actions": [{"action": "block", "tier": "T2", "requires_human_approval": True, "response_action": "block_ip"}, {"action": "ask", "tier": "T1"}, {"action": "note", "tier": "T1", "response_action": None}],
    "citations": [{"claim": "seen", "classification": "observed", "evidence_ids": ["E1", 7, "E9", None, {}]}, {"claim": "look", "classification": "AI_RECOMMENDATION"}],
}


def changed(path, value):
    doc = json.loads(json.dumps(SOUND))
    at = doc
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return doc


#: A change of the sound document, and the (check, path, value) rows that it gives.
CASES = [
    (("incident_id",), "inc-2", [("incident_id", "$.incident_id", "inc-2")]),
    (("incident_id",), None, [("incident_id", "$.incident_id", None)]),
    (("evidence", 0, "event_ids"), ["e1", "zz", 5], [("unknown_event", "$.evidence[0].event_ids[1]", "zz"), ("unknown_event", "$.evidence[0].event_ids[2]", "5")]),
    (("technique_ids",), ["T9999", "T1003", "T9999", "T1059"], [("unknown_technique", "$.technique_ids[0]", "T9999"), ("unmapped_technique", "$.technique_ids[3]", "T1059")]),
    (("citations", 0, "evidence_ids"), ["E9"], [("unsupported_claim", "$.citations[0]", "seen")]),
    (("citations", 1, "evidence_ids"), ["E9"], [("unsupported_claim", "$.citations[1]", "look")]),
    (("citations", 1, "classification"), "guess", [("unsupported_claim", "$.citations[1]", "look")]),
    (("summary",), "I isolated it. Action taken, and it has been closed", [("performed_action", "$.summary", n) for n in "015"]),
    (("recommended_actions", 1, "action"), "I am blocking it", [("performed_action", "$.recommended_actions[1].action", "3")]),
    (("citations", 0, "claim"), "they have been disabled; I will close it", [("performed_action", "$.citations[0].claim", n) for n in "24"]),
    (("confidence",), "certain", [("confidence", "$.confidence", "certain")]),
    (("proposed_only",), False, [("proposed_only", "$.proposed_only", "false")]),
    (("recommended_actions", 0, "requires_human_approval"), None, [("approval", "$.recommended_actions[0].requires_human_approval", "T2")]),
    (("recommended_actions", 0, "response_action"), "wipe", [("unknown_action", "$.recommended_actions[0].response_action", "wipe")]),
    (("recommended_actions", 0, "tier"), "T1", [("tier", "$.recommended_actions[0].tier", "T1")]),
    (("evidence",), "none", [("shape", "$.evidence", "STRING")]),
    (("evidence", 0, "event_ids"), "e1", [("shape", "$.evidence[0].event_ids", "STRING")]),
    (("summary",), ["x"], [("shape", "$.summary", "ARRAY<STRING>")]),
    (("recommended_actions", 1, "tier"), 2, [("shape", "$.recommended_actions[1].tier", "BIGINT")]),
    (("citations",), None, []), (("extra",), {"deep": [1]}, []), (("summary",), "No host has been isolated", []),
]


def test_every_check(spark):
    docs = [changed(path, value) for path, value, _ in CASES] + [SOUND]
    texts = [json.dumps(d) for d in docs] + ["[1]", '"x"', None, "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, j string").select("id", F.lit("inc-1").alias("incident"), F.parse_json("j").alias("v"))
    events = spark.createDataFrame([("inc-1", "e1"), ("inc-1", "e2"), ("inc-2", "zz")], "incident string, event_id string")
    techniques = spark.createDataFrame([("inc-1", "T1003"), ("inc-2", "T1059")], "incident string, technique string")
    evidence = spark.createDataFrame([("inc-1", "E1", "e2"), ("inc-1", "E1", "e1"), ("inc-1", "7", "e2"), ("inc-1", "7", "e3"), ("inc-2", "E9", "zz")], "incident string, evidence_id string, event_id string")
    got = {}
    for r in analyses.violations(rows, events, techniques, evidence).collect():
        got.setdefault(r.id, []).append((r.check, r.path, r.value))
    want = {i: sorted(w) for i, (_, _, w) in enumerate(CASES) if w}
    n = len(docs)
    want |= {n: [("shape", "$", "ARRAY<BIGINT>")], n + 1: [("shape", "$", "STRING")], n + 2: [("shape", "$", "missing")], n + 3: [("confidence", "$.confidence", None), ("incident_id", "$.incident_id", None), ("proposed_only", "$.proposed_only", None)]}
    assert {i: sorted(g, key=str) for i, g in got.items()} == {i: sorted(w, key=str) for i, w in want.items()}
    said = {(r.id, r.path): (r.classification, r.event_ids, r.bad, r.supported) for r in analyses.citations(rows, evidence).collect()}
    assert said[n - 1, "$.citations[0]"] == ("OBSERVED", ["e1", "e2", "e3"], ["E9"], True) and said[n - 1, "$.citations[1]"] == ("AI_RECOMMENDATION", [], [], True)


def test_unknown_ids_keep_the_order_of_citation(spark):
    doc = json.dumps({"citations": [{"claim": "c", "evidence_ids": ["E50", "E160x", "E1", "E160x", "E50", "E2"]}]})
    rows = spark.createDataFrame([(1, doc)], "id long, j string").select("id", F.lit("inc-1").alias("incident"), F.parse_json("j").alias("v"))
    evidence = spark.createDataFrame([("inc-1", "E1", "e9"), ("inc-1", "E2", "e3")], "incident string, evidence_id string, event_id string")
    said = analyses.citations(rows, evidence).first()
    assert said.bad == ["E50", "E160x"] and said.event_ids == ["e9", "e3"]
