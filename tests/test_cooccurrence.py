"""Pairs that share groups, one of which holds a third of all rows, against plain counting."""

import collections
import itertools
import random

from cinderlake.operators import context, graph


def test_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_GROUP", 8)
    rnd = random.Random(1)
    for hot in (0, 300):
        rows = [(g, rnd.randrange(40 if g % 2 else 400)) for g in range(120) for _ in range(rnd.randint(1, 6))] + [(1000, x) for x in range(hot)] + [(1001, x) for x in range(0, hot, 3)] + [(None, 1), (5, None)] + [(0, 3)] * 4
        df = spark.createDataFrame(rows, "g long, x long")
        sets = collections.defaultdict(set)
        for g, x in rows:
            if g is not None and x is not None:
                sets[g].add(x)
        counts = collections.Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
        want = sorted(((a, b, n) for (a, b), n in counts.items()), key=lambda r: (-r[2], r[0], r[1]))[:40]
        top = graph.cooccurrence(df, "g", "x")
        assert [tuple(r) for r in top.collect()] == want
        nodes = {r.x: r.n for r in graph.cooccurrence_nodes(df, top, "g", "x").collect()}
        assert nodes == {x: sum(x in s for s in sets.values()) for x in {y for a, b, _ in want for y in (a, b)}}
    assert graph.cooccurrence(df.limit(0), "g", "x").count() == 0


def test_items_keep_nulls_and_name_few(spark):
    """Items of unknown category or action stay; a burst over many accounts names the first eight."""
    columns = "pos long, t long, event_id string, category string, action string, outcome string, severity int, username string, hostname string, source_ip string, destination_ip string, destination_port int, process string, parent_process string, account string, resource string, principal_arn string, seed boolean, rule_id string, technique string"
    row = lambda i, category, user: (i, i, f"e{i:03d}", category, None if i == 1 else "a", "failure", 1, user, "h", "1.2.3.4", None, None, None, None, None, None, None, False, None, None)
    rows = [row(0, None, None), row(1, "dns", "x")] + [row(10 + i, "authentication", f"u{i:02d}") for i in range(30)]
    got = {r.n: r for r in context.items(spark.createDataFrame(rows, columns)).collect() if r.n > 1}
    found = context.items(spark.createDataFrame(rows, columns))
    assert got[30].actors == [f"u{i:02d}" for i in range(8)]
    assert {(r.event_id, tuple(r.actors)) for r in found.where("n = 1").collect()} == {("e000", ()), ("e001", ("x",))}
    assert {r.item: r.n for r in context.item_events(spark.createDataFrame(rows, columns), found).groupBy("item").count().withColumnRenamed("count", "n").collect()} == {1: 1, 2: 1, 3: 30}
