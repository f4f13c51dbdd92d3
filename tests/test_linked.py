"""Clusters need an event's latest predecessor only, and what a bucket of time hands to another one needs no join with the rows."""

import random

from pyspark.sql import functions as F

from cinderlake.operators import features, graph, joins
from cinderlake.plans.stored import materialize
from cinderlake.sources.telemetry import normalized

HOUR = 3_600_000_000


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_linked_clusters(spark):
    rng = random.Random(7)
    rows = [(f"e{rng.randrange(40)}", rng.choice([None, rng.randrange(60 * HOUR), HOUR * rng.randrange(60)]), pos) for pos in range(300) for _ in range(2)]
    entities = spark.createDataFrame(rows, "entity string, t long, pos long").dropDuplicates(["pos", "entity"])
    events = entities.select("pos").distinct()
    linked = materialize(graph.links(entities).drop("entity"), "links")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in graph.linked_clusters(events, linked).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {tuple(r) for r in graph.clusters(events, graph.link_edges(entities)).collect()}
    assert len(got) == 300 and 2 < len({cluster for _, cluster in got}) < 300


def test_nearest_seed_joins_nothing(spark):
    rows = [(i, i * 7 * HOUR, f"e{i % 3}", i % 5 == 0) for i in range(60)]
    assert plan(joins.nearest_seed(spark.createDataFrame(rows, "pos long, t long, entity string, seed boolean"))).count("Join") == 0


def test_features_write_links_not_edges(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(features, "materialize", lambda df, name: written.update({name: df.columns}) or materialize(df, name))
    out = features.feature_matrix(normalized(spark, "/root/testdata/sf0.001"))
    assert written["feature-links"] == ["pos", "t", "before"] and not {"username", "entities", "detection_ids"} & set(written["feature-events"])
    assert out.where(F.col("degree") > 0).count() > 0
