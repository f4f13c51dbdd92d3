"""External sources are judged by address, once each, not by event."""

from pyspark.sql import functions as F

from cinderlake.operators import correlation


def test_addresses_are_judged_after_grouping(spark):
    rows = spark.createDataFrame([("10.0.0.1", 1), ("8.8.8.8", 5), ("8.8.8.8", 3), (None, 4), ("8.8.8.300", 6), ("172.16.0.9", 7), ("172.15.0.9", 8)], "source_ip string, pos long")
    found = correlation.external_sources(rows)
    assert {tuple(r) for r in found.collect()} == {("8.8.8.8", 2, 3), ("172.15.0.9", 1, 8)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split(") < plan.index("Aggregate") and "split(" not in plan[plan.index("Aggregate") :]
    logons = rows.select("*", F.lit("authentication").alias("category"), F.lit("failure").alias("outcome"), F.col("pos").alias("t"), F.lit("logon").alias("action"), F.lit("p").alias("process"))
    signals = correlation.baseline_signals(logons).where("signal = 'SIG-EXT-SRC'")
    assert {(r.place, r.ip, r.n) for r in signals.collect()} == {(1, "172.15.0.9", 1), (2, "8.8.8.8", 2)}
