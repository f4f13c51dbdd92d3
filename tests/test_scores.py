"""Scores next to a half of their last digit are those of DuckDB, whose SQL the queries must match."""

import pytest

from cinderlake.event_queries import _ADDED
from cinderlake.operators import evidence


def test_scores_round_like_the_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(dm, w5, s / 4, r / 1e6, w60) for dm in (0, 1) for w5 in (0, 1) for s in range(5) for w60 in (0, 1) for r in (150130, 150522, 150890, 151058, 158218)]
    frame = spark.createDataFrame(rows, "detection_match int, within_5_minutes int, severity double, rarity double, within_1_hour int")
    got = frame.select("*", evidence.rounded(evidence.rule_score(frame, _ADDED)).alias("score")).collect()
    con = duckdb.connect()
    for *given, score in got:
        assert con.execute("SELECT round((3.0 * dm + w5 + sev + LEAST(1.0, GREATEST(0.0, rarity)) + 0.5 * w60) / 12.0, 6) FROM (SELECT ?::INT AS dm, ?::INT AS w5, ?::DOUBLE AS sev, ?::DOUBLE AS rarity, ?::INT AS w60)", given).fetchone() == (score,)
