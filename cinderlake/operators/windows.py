"""Sliding windows over time: thresholds, bursts, rare shapes, transitions and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.plans.buckets import DAY, WINDOWS_A_BUCKET, bucket_of, carried, looking_back, same_bucket
from cinderlake.plans.stored import materialize, numbered


def inside(rows: DataFrame, seconds: int, distinct: bool = False) -> DataFrame:
    """rows(key, t, ...) with n_inside: rows of the key in the closed window that ends at t; with distinct, n_kinds too:
    different non-null d there.

    Every row counts one up at its time and one down when its window has passed, and so does every stretch of time in
    which a d is in sight; a running sum over these marks gives the counts in one pass, bucket by bucket. Rows without
    time are left out."""
    span = max(seconds, 1) * 1_000_000
    spread = looking_back(rows.where("t is not null"), span).repartition("key", "bucket")
    opens = closes = F.lit(0)
    if distinct:
        of_kind = Window.partitionBy("key", "bucket", "d").orderBy("t")
        spread = spread.withColumn("before", F.lag("t").over(of_kind)).withColumn("after", F.lead("t").over(of_kind))
        opens = F.expr(f"if(d is not null and (before is null or t - before > {span}), 1, 0)")
        closes = F.expr(f"if(d is not null and (after is null or after - t > {span}), 1, 0)")
    mark = lambda at, own, n, kinds: F.struct(at.alias("at"), own.alias("real"), F.lit(n).alias("n"), kinds.alias("kinds"))
    marks = spread.withColumn("m", F.explode(F.array(mark(F.col("t"), F.col("own"), 1, opens), mark(F.col("t") + span + 1, F.lit(False), -1, -closes))))
    w = Window.partitionBy("key", "bucket").orderBy("at")
    summed = marks.select(*rows.columns, "bucket", "m.*").withColumn("n_inside", F.sum("n").over(w))
    if distinct:
        summed = summed.withColumn("n_kinds", F.sum("kinds").over(w))
    return summed.where("real").select(*rows.columns, "n_inside", *(["n_kinds"] if distinct else []))


def threshold(rows: DataFrame, n: int, seconds: int, distinct: bool = False) -> DataFrame:
    """First window of each key in which rows(key, t, pos[, d]) reach n; at most one alert per key.

    The window is closed on both ends. With distinct, distinct non-null d count if there are any, else rows. The alert
    cites all rows from the window's start to `seconds` later. Rows without key or time are left out."""
    span = max(seconds, 1) * 1_000_000
    counted = inside(rows, seconds, distinct)
    met = F.col("n_inside") >= n
    if distinct:
        met = F.when(F.col("n_kinds") > 0, F.col("n_kinds") >= n).otherwise(met)
    hit = counted.where(met).groupBy("key").agg(F.min("t").alias("hit"))
    # What an alert cites lies in two buckets at most, so rows are dealt by key and bucket here too.
    bucket = lambda t: bucket_of(t, WINDOWS_A_BUCKET * span)
    near = hit.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("hit") - span), bucket(F.col("hit") + span)))))
    seen = rows.where("t is not null").withColumn("bucket", bucket(F.col("t"))).join(near, ["key", "bucket"]).where(F.abs(F.col("t") - F.col("hit")) <= span)
    listed = seen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "pos"))).alias("all"))
    cited = listed.select("key", F.filter("all", lambda x: x["t"] <= F.col("all")[0]["t"] + span).alias("c"))
    return cited.select("key", F.size("c").cast("long").alias("n_events"), F.col("c")[0]["t"].alias("first_t"), F.element_at("c", -1)["t"].alias("last_t"), F.transform("c", lambda x: x["pos"]).alias("evidence"))


def burst(rows: DataFrame, n: int = 5, seconds: int = 600) -> DataFrame:
    """Keys with n rows in a window; the alert cites all timed rows of the key, not only the window's."""
    counted = inside(rows, seconds)
    return counted.groupBy("key").agg(F.count("*").alias("n_events"), F.min("t").alias("first_t"), F.max("n_inside").alias("peak")).where(F.col("peak") >= n)


def after_burst(bursts: DataFrame, successes: DataFrame) -> DataFrame:
    """Successes of a key at or after the key's first failure."""
    return successes.join(bursts.select("key", "first_t"), "key").where(F.col("t") >= F.col("first_t")).groupBy("key").agg(F.count("*").alias("n_success"), F.min("pos").alias("first_pos"))


def rare(rows: DataFrame, shape: list[str], most: int = 2) -> DataFrame:
    """Rows whose shape occurs at most `most` times; nulls are values like others."""
    counted = rows.groupBy(*shape).agg(F.count("*").alias("shape_count"))
    few = counted.where(F.col("shape_count") <= most).select(*[F.col(c).alias(f"shape_{c}") for c in shape], "shape_count")
    same = [F.col(c).eqNullSafe(F.col(f"shape_{c}")) for c in shape]
    return rows.join(few, same).select(*rows.columns, "shape_count")


def frequency(rows: DataFrame, shape: list[str]) -> DataFrame:
    """Per shape: count, share of all rows and rarity 1 - ln(1+c)/ln(1+n)."""
    counted = rows.groupBy(*shape).agg(F.count("*").alias("c"))
    total = counted.agg(F.sum("c").alias("n"))
    both = counted.join(F.broadcast(total))
    return both.select(*shape, "c", F.round(F.col("c") / F.col("n"), 6).alias("event_frequency"), F.round(1 - F.log1p("c") / F.log1p("n"), 6).alias("rarity"))


def transitions(rows: DataFrame, state: list[str], first: bool = False) -> DataFrame:
    """rows(key, t, pos, ...) with changed: the state differs from the key's previous row; `first` for a row without one.

    A bucket's first row is compared with the last state of the key's buckets before."""
    now, at = F.struct(*state), F.struct("t", "pos")
    spread = rows.withColumn("bucket", bucket_of(F.col("t"), DAY))
    last = carried(spread, "key", {"tail": F.max_by(F.struct(now.alias("s")), at)}, {"tail": (F.last("tail"), "before")})
    w = Window.partitionBy("key", "bucket").orderBy("t", "pos")
    joined = spread.withColumn("place", F.row_number().over(w)).withColumn("previous", F.lag(now).over(w)).join(last, same_bucket("key"), "left")
    previous = F.when(F.col("place") == 1, F.col("tail.s")).otherwise(F.col("previous"))
    opening = (F.col("place") == 1) & F.col("tail").isNull()
    return joined.withColumn("changed", F.when(opening, F.lit(first)).otherwise(~previous.eqNullSafe(now))).select(*rows.columns, "changed")


def chain(rows: DataFrame, state: str) -> DataFrame:
    """Runs of neighbouring rows of a key with equal state: (key, island, state, n, first_pos, last_pos)."""
    marked = transitions(rows, [state], first=True).withColumn("new", F.col("changed").cast("int")).withColumn("bucket", bucket_of(F.col("t"), DAY))
    begun = carried(marked, "key", {"news": F.sum("new")}, {"begun": (F.sum("news"), "before")})
    w = Window.partitionBy("key", "bucket").orderBy("t", "pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.withColumn("here", F.sum("new").over(w)).join(begun, same_bucket("key"), "left")
    numbered_ = joined.withColumn("island", F.col("here") + F.coalesce("begun", F.lit(0)))
    return numbered_.groupBy("key", "island", state).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def islands(ids: DataFrame, column: str, bucket: int = 1 << 20) -> DataFrame:
    """Maximal runs (lo, hi, n) of consecutive whole numbers.

    Numbers are grouped in buckets of neighbouring values first, so no task sees them all; runs that touch a bucket's
    edge are then joined."""
    numbers = ids.select(F.col(column).alias("x")).where("x is not null").distinct().withColumn("b", F.expr(f"x div {bucket}"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("x"))
    runs = numbers.withColumn("g", F.col("x") - place).groupBy("b", "g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    edge = materialize(runs.where(f"pmod(lo, {bucket}) = 0 or pmod(hi, {bucket}) = {bucket - 1}").select("lo", "hi"), "edge-runs")
    # In order, the n-th run without a predecessor begins what the n-th run without a successor ends.
    begins = edge.select("lo").join(edge.select((F.col("hi") + 1).alias("lo")), "lo", "left_anti")
    ends = edge.select("hi").join(edge.select((F.col("lo") - 1).alias("hi")), "hi", "left_anti")
    joined = numbered(begins, [F.asc("lo")]).join(numbered(ends, [F.asc("hi")]), "n")
    inner = runs.where(f"not (pmod(lo, {bucket}) = 0 or pmod(hi, {bucket}) = {bucket - 1})").select("lo", "hi")
    return inner.union(joined.select("lo", "hi")).withColumn("n", F.col("hi") - F.col("lo") + 1)


def capped(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key in the order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)
