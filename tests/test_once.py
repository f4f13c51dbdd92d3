"""What a query reads or makes of a row is made once, and spans of many incidents meet an event once."""

from pyspark.sql import functions as F

from cinderlake import context_queries
from cinderlake.operators import correlation, documents, features, joins, typed
from cinderlake.plans.stored import materialize
from cinderlake.sources.telemetry import normalized, telemetry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_props_are_read_once(spark):
    asked = telemetry(spark, DATA).where("action = 'logon' and outcome = 'success' and source_ip like '203%'")
    assert plan(asked.select("pos", "action", "outcome", "source_ip")).count("get_json_object") == 1
    found = context_queries._messages(spark, DATA).where("message like '%@%' or message like 'x%'").select("pos", "message")
    assert plan(found).count("get_json_object") == 1 and plan(found).count("IGNORE all previous") == 1


def test_surrounding(spark):
    hour = 3_600_000_000
    evidence = spark.createDataFrame([(f"a{i}", i, ["host:h", f"user:{i}"]) for i in range(20)], "alert_id string, pos long, entities array<string>")
    owned = evidence.select("alert_id", F.concat(F.lit("inc-"), "pos").alias("incident_id"))
    incidents = evidence.select(F.concat(F.lit("inc-"), "pos").alias("incident_id"), (F.col("pos") % 7 * 5 * hour).alias("first_t"), ((F.col("pos") % 7 * 5 + F.col("pos") % 3) * hour).alias("last_t"))
    events = spark.range(400).select(F.col("id").alias("pos"), (F.col("id") * (hour // 10)).alias("t"), F.when(F.col("id") % 3 > 0, F.array(F.lit("host:h"), F.lit("x"))).when(F.col("id") % 2 > 0, F.array(F.lit("user:3"))).alias("entities"))
    pairs = correlation.relevant_events(events, incidents, owned, evidence)
    want = {r.pos for r in pairs.collect()} | set(range(20))
    got = [r.pos for r in correlation.surrounding(events, incidents, owned, evidence).collect()]
    assert sorted(got) == sorted(want) and 20 < len(want) < 400


def test_given_identifiers_are_not_searched(spark, monkeypatch):
    rows = [("1", 7, 1, ".actor", "eve", "USER"), ("2", 7, 1, ".note", "for eve and pw=abc123", None), ("3", None, 1, ".actor", "eve", "USER"), ("4", 7, 2, ".actor", "ann", "USER"), ("5", 7, 2, ".password", "eve", None)]
    texts = spark.createDataFrame(rows, "id string, pack int, place int, path string, text string, kind string")
    searched, swap = [], documents.swapped
    monkeypatch.setattr(documents, "swapped", lambda rows, *more: searched.append(sorted(r.id for r in rows.collect())) or swap(rows, *more))
    done, _ = documents.redacted_texts(texts, "pack")
    got = {r.id: (r.text, r.changed) for r in done.collect()}
    assert searched == [["2", "5"]]
    assert (got["1"], got["3"], got["4"], got["5"]) == (("USER_001", True), ("eve", False), ("USER_002", True), ("[REDACTED_SECRET_FIELD]", True))
    assert got["2"][0].startswith("for USER_001 and ")


def test_item_fields_names_what_it_reads_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(typed, "materialize", lambda df, name: plans.append(plan(df)) or materialize(df, name))
    docs = spark.range(1).select(F.col("id").alias("pos"), F.lit(1).alias("pack"), F.col("id").alias("place"), F.parse_json(F.lit('{"category": "dns", "dns": {"source_ip": "1.2.3.4"}}')).alias("v"))
    assert '"source_ip":"1.2.3.4"' in typed.item_fields(docs, "pos", "pack").first().fields
    assert plans[0].count("$.cloud,") == 1 and plans[0].count("$.source_ip,") == 7 and "$.cloud." not in plans[0]


def test_features_make_entities_once(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(features, "materialize", lambda df, name: plans.update({name: plan(df)}) or materialize(df, name))
    out = features.feature_matrix(normalized(spark, DATA))
    assert [n for n, p in plans.items() if "array_distinct" in p] == ["feature-events"]
    # Clusters are worked out by type and source, not by event: the last step meets them in one join.
    assert plans["feature-kinds"].count("Join") == 0 and plan(out).count("feature-edges") == 0
    assert out.count() == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_nearest_seed_with_known_seeds(spark):
    rows = [(i, i * 1000 * (i % 7), f"e{i % 3}", i % 5 == 0) for i in range(60)]
    entities = spark.createDataFrame(rows, "pos long, t long, entity string, seed boolean")
    known = joins.nearest_seed(entities).collect()
    assert sorted(known) == sorted(joins.nearest_seed(entities.drop("seed"), entities.where("seed")).collect()) and len(known) == 60
