"""The registered queries' rows make every branch of their operators fire: fixed lists are counted against what the results hold."""

import pytest
from pyspark.sql import functions as F

from cinderlake import catalog, document_queries, pack_queries, validation_queries
from cinderlake.functions import policy
from cinderlake.operators import signatures

DATA = "/root/testdata/sf0.01"


def values(spark, query, column):
    return {r[0] for r in catalog.queries()[query](spark, DATA).select(column).distinct().collect()}


def test_all_rules_fire(spark):
    assert values(spark, "signature_branches", "rule_id") == {r.rule_id for r in signatures.rules()}


def test_all_secrets_and_instructions(spark):
    texts = catalog.queries()["redact_documents"](spark, DATA)
    kinds = {r[0] for r in texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\[REDACTED_([A-Z_]+)\]"), F.lit(1)))).distinct().collect()}
    assert kinds == {*policy.SECRETS, "SECRET_FIELD"}
    names = {r[0] for r in texts.select(F.explode(F.regexp_extract_all("text", F.lit("(USER|ACCESS_KEY|AWS_ACCOUNT)_001"), F.lit(1)))).distinct().collect()}
    assert names == {"USER", "ACCESS_KEY", "AWS_ACCOUNT"}
    assert values(spark, "screen_documents", "pattern") == set(range(len(policy.INSTRUCTIONS))) and len(document_queries.PLANTED) == len(policy.INSTRUCTIONS)


def test_all_checks_of_documents(spark):
    assert values(spark, "analysis_violations", "check") == {check for check, _, _ in pack_queries._WRONG.values()}
    assert values(spark, "event_faults", "fault") == {None, *(w.replace("''", "'") for w in validation_queries._WRONG.values())}


def test_all_ways_of_trimming(spark):
    rows = catalog.queries()["pack_budgets"](spark, DATA).collect()
    assert any(r.cut and not r.popped for r in rows) and any(r.popped for r in rows)
    assert any(r.clipped for r in rows) and any(not r.cut for r in rows) and max(r.n_items for r in rows) > 15
    assert {r.n_preserved for r in catalog.queries()["fact_retention"](spark, DATA).collect()} & set(range(1, 14))


@pytest.mark.parametrize("query,column,wanted", [("segment_audit", "n_broken", 1), ("segment_audit", "n_missing", 1), ("segments_twice", "n_segments", 2), ("attack_path", "missed", 1), ("missed_stages", "missed_order", 1)])
def test_counts_are_not_empty(spark, query, column, wanted):
    assert max(v for v in values(spark, query, column) if v is not None) >= wanted
