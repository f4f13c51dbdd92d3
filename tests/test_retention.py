"""Facts ask for their own events only, links of items are counted without pairs, and budgets share one set of sums."""

import random

from pyspark.sql import functions as F

from cinderlake import catalog, pack_queries
from cinderlake.operators import context, packs
from cinderlake.plans.stored import materialize
from cinderlake.sources.telemetry import telemetry

DATA = "/root/testdata/sf0.001"


def test_items_of_some_events(spark):
    events = telemetry(spark, DATA)
    found = context.items(events)
    whole = {(r.item, r.pos) for r in context.item_events(events, found).collect()}
    some = {(r.item, r.pos) for r in context.item_events(events.where("pos % 7 = 0"), found).collect()}
    assert some == {(item, pos) for item, pos in whole if pos % 7 == 0} and some and len(whole) == events.count()


def test_linked_items(spark):
    """Entities of up to four items are put together, those of five give all points at once."""
    rng = random.Random(3)
    names = {i: {f"u{rng.randrange(14)}" for _ in range(rng.randrange(3))} | {f"v{i // 2}"} for i in range(1, 41)}
    rows = [(i, 1, [], [], 0, "common", 2, sorted(names[i])) for i in names]
    found = spark.createDataFrame(rows, "item long, first_t long, rules array<string>, techniques array<string>, severity int, rarity string, n long, actors array<string>")
    none = F.lit(None).cast("string")
    found = found.withColumns({c: none for c in ("username", "hostname", "source_ip", "account", "principal_arn", "process", "destination_ip", "resource")})
    got = {r.item: r.entity_link for r in context.scores(found).collect()}
    want = {i: min(20, 5 * sum(bool(names[i] & names[j]) for j in names if j != i)) for i in names}
    assert got == want and {5, 20} <= set(want.values()) and len(set(want.values())) > 2


def test_budgets_share_their_sums(spark, monkeypatch):
    written = []
    for module in (packs, pack_queries):
        monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    rows = catalog.queries()["fact_retention"](spark, DATA).collect()
    assert sorted(r.budget for r in rows) == sorted(pack_queries.BUDGETS)
    assert [written.count(n) for n in ("freed", "tail", "cuts", "alive")] == [1, 1, 1, 0]


def test_budgets_without_facts_stay(spark, monkeypatch):
    # No context item and no detection holds an event of the fact: every budget still has its row.
    monkeypatch.setattr(context, "item_events", lambda events, found: found.where("false").select("item", F.lit(0).cast("long").alias("pos")))
    rows = catalog.queries()["fact_retention"](spark, DATA).collect()
    assert sorted(r.budget for r in rows) == sorted(pack_queries.BUDGETS) and {r.n_preserved for r in rows} == {0}
