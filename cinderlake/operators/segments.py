"""Numbers in intervals: a join that neither broadcasts nor crosses, counts without pairs, segment audits, and coverage of event sets by bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.plans.stored import materialize

#: Blocks of a level are this many of the level below; levels beyond a long don't exist.
FAN, LEVELS = 64, 11


def blocks_of(lo: Column, hi: Column) -> Column:
    """Aligned blocks (level, block) that make up a closed interval, each as large as fits; none if it is empty or has a null.

    Numbers are whole, at least 0 and under 2^62; an interval has at most 2 * (FAN - 1) blocks of a level."""
    none = F.array().cast("array<struct<level:int,block:long>>")
    run = lambda level, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))).otherwise(none)
    parts = []
    for level in range(LEVELS):
        size, larger = FAN**level, FAN ** (level + 1)
        first = lambda s: F.call_function("div", lo + (s - 1), F.lit(s).cast("long"))
        after = lambda s: F.call_function("div", hi + 1, F.lit(s).cast("long"))
        whole = run(level, first(size), after(size))
        if level + 1 < LEVELS:  # what the next level leaves over at both ends
            a, b = first(larger), after(larger)
            whole = F.when(a < b, F.concat(run(level, first(size), a * FAN), run(level, b * FAN, after(size)))).otherwise(whole)
        parts.append(whole)
    return F.when((lo <= hi) & (lo >= 0), F.concat(*parts)).otherwise(none)


def stabbed(points: DataFrame, number: str, intervals: DataFrame) -> DataFrame:
    """points with the columns of each of the intervals(lo, hi, ...) that holds their number.

    Intervals are cut into aligned blocks and a number lies in one block a level, so this is an equi-join by (level, block);
    a number meets an interval once. Only levels that some interval uses are tried (LEVELS at most)."""
    cut = intervals.withColumn("_b", F.explode(blocks_of(F.col("lo").cast("long"), F.col("hi").cast("long")))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())
    at = F.array(*[F.struct(F.lit(x).alias("level"), F.call_function("div", F.col(number).cast("long"), F.lit(FAN**x).cast("long")).alias("block")) for x in levels]) if levels else F.array().cast("array<struct<level:int,block:long>>")
    tried = points.where(F.col(number) >= 0).withColumn("_b", F.explode(at)).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    return tried.join(cut, ["_level", "_block"]).drop("_level", "_block")


def swept(points: DataFrame, number: str, intervals: DataFrame, tallies: dict[str, Column]) -> DataFrame:
    """(_at, _side, _open, intervals' columns, tallies): points and both ends of the closed intervals(lo, hi, ...) in one order.

    _side is -1 where an interval begins (before the points of its lo), 0 for a point and 1 where one ends (behind those of its hi).
    A tally is how many points up to here meet its condition, _open how many intervals are open: what lies in an interval is a difference
    of two rows, and no pair of a point and an interval is made. Linear after the sort, in range partitions. Points should be unique by
    number: equal ones meet in one task. Empty intervals and those with a null end have no rows, nor do points without a number."""
    names = [*tallies, "_open"]
    steps = [F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in tallies.items()]
    at = points.where(F.col(number).isNotNull()).select(F.col(number).cast("long").alias("_at"), F.lit(0).alias("_side"), *steps, F.lit(0).cast("long").alias("_open"))
    end = lambda c, side: F.struct(F.col(c).cast("long").alias("_at"), F.lit(side).alias("_side"), F.lit(-side).cast("long").alias("_open"))
    ends = intervals.where("lo <= hi").select("*", F.inline(F.array(end("lo", -1), end("hi", 1)))).withColumns({n: F.lit(0).cast("long") for n in tallies})
    both = at.unionByName(ends, allowMissingColumns=True)
    # Ends at one number are alike, so any order of theirs does; with one they can be dealt to several partitions.
    order = ["_at", "_side", F.xxhash64(*intervals.columns)]
    ranged = materialize(both.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "swept")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = ranged.groupBy("_part").agg(*[F.sum(n).alias(n) for n in names]).select("_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in names])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumns({n: F.sum(n).over(inside) for n in names}).join(F.broadcast(before), "_part")
    return running.select("_at", "_side", *intervals.columns, *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in names])


def merged(intervals: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo, hi): the numbers of a key's closed intervals as intervals that don't overlap."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    apart = F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    return intervals.where("lo <= hi").withColumn("_new", apart).withColumn("_run", F.sum("_new").over(w)).groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def segment_audit(events: DataFrame, segments: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(by segment, twice): segments(segment, stage, lo, hi) against events(n, ...), whose numbers are unique.

    By segment: n_events in it, n_missing numbers without an event, n_broken events that don't meet the rule of its stage (a
    condition on events; unknown counts as broken, a stage without a rule has no condition). twice: (n, n_segments) of numbers in several segments."""
    wrong = {f"_r{i}": ~F.coalesce(F.expr(rule), F.lit(False)) for i, rule in enumerate(rules.values())}
    rows = swept(events, "n", segments, {"_n": F.lit(True)} | wrong)
    broken = F.lit(0).cast("long")
    for stage, tally in zip(rules, wrong):
        broken = F.when(F.col("stage") == stage, F.col(tally)).otherwise(broken)
    counted = rows.where("_side <> 0").groupBy(F.col("segment").alias("_s")).agg(F.sum(F.col("_side") * F.col("_n")).alias("n_events"), F.sum(F.col("_side") * broken).alias("n_broken"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long"))
    size = F.coalesce(F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0)), F.lit(0)).cast("long")
    out = segments.join(counted, F.col("segment") == F.col("_s"), "left").select("segment", "stage", zero("n_events").alias("n_events"), (size - zero("n_events")).alias("n_missing"), zero("n_broken").alias("n_broken"))
    return out, rows.where("_side = 0 and _open > 1").select(F.col("_at").alias("n"), F.col("_open").alias("n_segments"))


def bitmaps(rows: DataFrame, *groups: str, pos: str = "pos") -> DataFrame:
    """(groups, bucket, bits): each group's positions (1 or more) as bitmaps, one row a bucket."""
    return rows.where(F.col(pos).isNotNull()).groupBy(*groups, F.bitmap_bucket_number(pos).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(pos)).alias("bits"))


def coverage(facts: DataFrame, evidence: DataFrame, *groups: str) -> DataFrame:
    """(groups, fact, n_events, n_found, preserved): how much of each fact(fact, pos) the evidence(groups, pos) of each group holds.

    Both are sets of positions kept as bitmaps: what both hold is counted by |F| + |E| - |F or E| a bucket; no list of ids is joined.
    A fact without events is preserved. Groups are those of evidence."""
    wanted = bitmaps(facts, "fact")
    held = bitmaps(evidence, *groups)
    names = evidence.select(*groups).distinct() if groups else None
    every = facts.select("fact").distinct()
    every = every.join(F.broadcast(names)) if groups else every  # few groups: one a budget or representation
    sizes = wanted.groupBy("fact").agg(F.sum(F.bitmap_count("bits")).alias("n_events"))
    met = wanted.withColumnRenamed("bits", "f").join(held.withColumnRenamed("bits", "e"), "bucket")
    # No function joins two bitmaps of a row, so each pair becomes two rows and one aggregate.
    pair = met.select(*groups, "fact", "bucket", (F.bitmap_count("f") + F.bitmap_count("e")).alias("n"), F.explode(F.array("f", "e")).alias("bits"))
    common = pair.groupBy(*groups, "fact", "bucket").agg((F.max("n") - F.bitmap_count(F.bitmap_or_agg("bits"))).alias("n")).groupBy(*groups, "fact").agg(F.sum("n").alias("n_found"))
    out = every.join(sizes, "fact", "left").join(common, [*groups, "fact"], "left")
    out = out.select(*groups, "fact", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_events", "n_found")])
    return out.withColumn("preserved", F.col("n_events") == F.col("n_found"))


def retention(covered: DataFrame, *groups: str) -> DataFrame:
    """(groups, n_facts, n_preserved, missing, retention_percent, citation_percent) of coverage(); null where nothing is asked."""
    agg = covered.groupBy(*groups).agg(F.count("*").alias("n_facts"), F.count_if("preserved").alias("n_preserved"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("preserved"), F.col("fact")))), ",").alias("missing"), F.sum("n_found").alias("f"), F.sum("n_events").alias("e"))
    percent = lambda a, b, n: F.round(F.expr(f"try_divide(100.0D * {a}, {b})"), 1).alias(n)
    return agg.select(*groups, "n_facts", "n_preserved", "missing", percent("n_preserved", "n_facts", "retention_percent"), percent("f", "e", "citation_percent"))
