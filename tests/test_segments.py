"""Interval joins, segment audits and coverage by bitmaps against plain loops."""

import random

from pyspark.sql import functions as F

from cinderlake.operators import segments


def test_blocks_make_up_the_interval(spark):
    rnd = random.Random(1)
    some = [(0, 0), (5, 4), (63, 64), (0, 63), (0, 4095), (1, 4096), (4095, 4097), (64, 127), (0, (1 << 62) - 1), (7, None), (None, 7), (-5, 3), (12345, 12345 + 64**3)]
    some += [(a, a + rnd.choice([0, 3, 100, 5000, 10**6])) for a in (rnd.randrange(10**7) for _ in range(60))]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(some)], "i int, lo long, hi long")
    for r in rows.withColumn("b", segments.blocks_of(F.col("lo"), F.col("hi"))).collect():
        spans = sorted((x.block * 64**x.level, (x.block + 1) * 64**x.level) for x in r.b)
        if r.lo is None or r.hi is None or r.lo > r.hi or r.lo < 0:
            assert spans == []
            continue
        assert spans[0][0] == r.lo and spans[-1][1] == r.hi + 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) <= 126 * 11


def test_stabbed(spark):
    """Overlapping, empty, huge and equal segments; repeated, null and negative numbers."""
    rnd = random.Random(2)
    spans = [(i, a, a + rnd.choice([-1, 0, 10, 200, 10**12])) for i, a in enumerate(rnd.randrange(3000) for _ in range(80))] + [(80, 5, 50), (81, 5, 50), (82, None, 9)]
    numbers = [rnd.randrange(4000) for _ in range(500)] * 2 + [None, -3, 10**13, 3 * 10**11]
    held = segments.stabbed(spark.createDataFrame(list(enumerate(numbers)), "row long, n long"), "n", spark.createDataFrame(spans, "segment long, lo long, hi long"))
    assert sorted((r.row, r.segment) for r in held.collect()) == sorted((i, s) for i, n in enumerate(numbers) for s, lo, hi in spans if None not in (n, lo) and lo <= n <= hi)
    assert "BroadcastNestedLoopJoin" not in held._jdf.queryExecution().toString() and "CartesianProduct" not in held._jdf.queryExecution().toString()
    assert segments.stabbed(spark.createDataFrame([(1,)], "n long"), "n", spark.createDataFrame([], "segment long, lo long, hi long")).count() == 0


def test_audit(spark):
    events = spark.createDataFrame([(n, None if n == 7 else n % 3) for n in range(100) if n != 12], "n long, kind int")
    parts = spark.createDataFrame([(1, "a", 5, 14), (2, "b", 10, 11), (3, "c", 50, 49), (4, "free", 95, 104)], "segment int, stage string, lo long, hi long")
    got, twice = segments.segment_audit(events, parts, {"a": "kind = 0", "b": "kind < 9", "c": "false"})
    assert {tuple(r) for r in got.collect()} == {(1, "a", 9, 1, 7), (2, "b", 2, 0, 0), (3, "c", 0, 0, 0), (4, "free", 5, 5, 0)}
    assert {tuple(r) for r in twice.collect()} == {(10, 2), (11, 2)}


def test_retention(spark):
    rnd = random.Random(3)
    facts = {f"F{i:02d}": {rnd.randrange(1, 200_000) for _ in range(rnd.randint(1, 30))} for i in range(14)} | {"F20": {32768, 32769, 65536}}
    held = {"whole": set().union(*facts.values()) | {5}, "half": {p for s in facts.values() for p in s if p % 2}, "one": facts["F03"] | facts["F20"]}
    rows = spark.createDataFrame([(f, p) for f, s in facts.items() for p in s for _ in range(2)] + [("none", None)], "fact string, pos long")
    evidence = spark.createDataFrame([(g, p) for g, s in held.items() for p in s] + [("one", None)], "who string, pos long")
    covered = segments.coverage(rows, evidence, "who")
    assert {(r.who, r.fact): (r.n_events, r.n_found, r.preserved) for r in covered.collect()} == {(g, f): (len(s), len(s & h), s <= h) for g, h in held.items() for f, s in [*facts.items(), ("none", set())]}
    got = {r.who: r for r in segments.retention(covered, "who").collect()}
    assert got["whole"].n_preserved == 16 and got["whole"].retention_percent == got["whole"].citation_percent == 100.0 and got["whole"].missing == ""
    assert got["one"].n_facts == 16 and got["one"].n_preserved == 3 and "F03" not in got["one"].missing and "F00" in got["one"].missing


def test_swept(spark):
    """Counts without pairs: nested, empty, huge, equal and negative segments, and ends at one number in several partitions."""
    rnd = random.Random(4)
    spans = [(i, a, a + rnd.choice([-1, 0, 10, 200, 10**12])) for i, a in enumerate(rnd.randrange(-50, 3000) for _ in range(300))] + [(300, 5, 50), (301, 5, 50), (302, None, 9)]
    numbers = [*range(-60, 2000, 3), 10**12, None]
    points = spark.createDataFrame([(n,) for n in numbers], "n long")
    rows = segments.swept(points, "n", spark.createDataFrame(spans, "segment long, lo long, hi long"), {"odd": F.expr("n % 2 <> 0"), "any": F.lit(True)}).collect()
    got = {}
    for r in rows:
        if r._side:
            one = got.setdefault(r.segment, [0, 0])
            one[0], one[1] = one[0] + r._side * r.odd, one[1] + r._side * r.any
    inside = lambda lo, hi: [n for n in numbers if n is not None and lo <= n <= hi]
    assert got == {s: [sum(n % 2 for n in inside(lo, hi)), len(inside(lo, hi))] for s, lo, hi in spans if lo is not None and lo <= hi}
    assert {r._at: r._open for r in rows if not r._side} == {n: sum(lo is not None and lo <= n <= hi for _, lo, hi in spans) for n in numbers if n is not None}


def test_audit_makes_no_pairs(spark, monkeypatch):
    """4,000 nested segments over 4,000 events would be 8 million pairs."""
    monkeypatch.setattr(segments, "stabbed", None)
    events = spark.range(4000).select(F.col("id").alias("n"), (F.col("id") % 2).alias("kind"))
    parts = spark.range(4000).select(F.col("id").alias("segment"), F.lit("a").alias("stage"), F.col("id").alias("lo"), F.lit(10**12).alias("hi"))
    got, twice = segments.segment_audit(events, parts, {"a": "kind = 0"})
    assert {(r.segment, r.n_events, r.n_broken) for r in got.collect()} == {(i, 4000 - i, (4000 - i + 1) // 2) for i in range(4000)}
    assert {tuple(r) for r in twice.collect()} == {(i, i + 1) for i in range(1, 4000)}
