"""Pairs of small groups are counted in parts whose number grows with the rows."""

from collections import Counter
from itertools import combinations

from cinderlake.operators import graph


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_ROWS", 100)
    monkeypatch.setattr(graph, "SMALL_GROUP", 6)
    groups = {g: {(g * 7 + i * i) % 40 for i in range(g % 9)} | {1, 2} for g in range(300)}
    spread, kept = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (spread.append(df.rdd.getNumPartitions()) if name == "counted" else None) or kept(df, name))
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    got = graph.cooccurrence(spark.createDataFrame(rows * 2 + [(None, 1), (1, None)], "g long, x long"), "g", "x", 10).collect()
    n = Counter(p for xs in groups.values() for p in combinations(sorted(xs), 2))
    assert [tuple(r) for r in got] == [(a, b, c) for (a, b), c in sorted(n.items(), key=lambda e: (-e[1], e[0]))[:10]]
    assert spread == [-(-len(rows) // 100)]
