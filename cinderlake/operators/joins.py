"""Nearest, completeness, overlap and evaluation joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.plans import buckets
from cinderlake.plans.buckets import bucket_of, carried

DAY = 86_400


def nearest_seed(entities: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(pos, ref, distance in microseconds): the nearest seed event that shares an entity, earlier or later.

    Of equally near seeds the least position wins; earlier seeds of one time give their largest position, later ones
    their smallest. A seed is its own reference. Without seeds, a column `seed` of entities tells them."""
    marked = entities if seeds is None else entities.join(seeds.select("pos", F.lit(True).alias("seed")), "pos", "left")
    marked = marked.withColumn("s", F.when(F.col("seed"), F.struct("t", "pos")))
    marked = marked.select("pos", "t", "seed", "entity", bucket_of(F.col("t"), buckets.DAY).alias("bucket"), "s")
    # Only seeds are compared for what a bucket hands on; of the others all that counts is which buckets there are.
    places = marked.where("s is not null").select("entity", "bucket", "s").unionByName(marked.select("entity", "bucket").distinct(), allowMissingColumns=True)
    ends = carried(places, "entity", {"greatest": F.max("s"), "least": F.min("s")}, {"earlier": (F.max("greatest"), "before"), "later": (F.min("least"), "after")})
    # What is carried to a bucket joins its rows as two more seeds, before and after all of them; no join with the rows is needed.
    carry = ends.select(F.col("key_").alias("entity"), F.col("bucket_").alias("bucket"), F.explode(F.array("earlier", "later")).alias("s")).where("s is not null")
    rows = marked.withColumn("own", F.lit(True)).unionByName(carry.select("s.pos", "s.t", F.lit(True).alias("seed"), "entity", "bucket", "s", F.lit(False).alias("own")))
    w = Window.partitionBy("entity", "bucket")
    # Times in descending order turn "from here on" into a running minimum.
    before = F.max("s").over(w.orderBy("t").rangeBetween(Window.unboundedPreceding, -1))
    after = F.min("s").over(w.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))
    near = rows.select("pos", "t", "seed", "own", before.alias("before"), after.alias("after")).where("own")
    way = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("t") - F.col(f"{c}.t")).alias("distance"), F.col(f"{c}.pos").alias("ref")))
    own = F.when(F.col("seed"), F.struct(F.lit(0).cast("long").alias("distance"), F.col("pos").alias("ref")))
    best = F.coalesce(own, F.least(way("before"), way("after")))
    # Dealt by pos first: an event's rows lie apart, so a partial aggregate would sort them all and join none.
    found = near.select("pos", best.alias("best")).where("best is not null").repartition("pos").groupBy("pos").agg(F.min("best").alias("best"))
    return found.select("pos", "best.ref", "best.distance")


def temporal_features(nearest: DataFrame) -> DataFrame:
    """Distance features of (pos, ref, distance): log distance, closeness flags and decay with 900 s."""
    d = F.col("distance") / 1e6
    flag = lambda s: (d <= s).cast("int")
    return nearest.select("pos", F.round(F.log1p(d), 6).alias("timestamp_distance"), flag(60).alias("within_1_minute"), flag(300).alias("within_5_minutes"), flag(900).alias("within_15_minutes"), flag(3600).alias("within_1_hour"), F.round(F.exp(-d / 900), 6).alias("temporal_proximity"))


def overlap(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared entities and Jaccard overlap of pairs(a, b), from entity sets (pos, entities array)."""
    both = pairs.join(left.select(F.col("pos").alias("a"), F.col("entities").alias("ea")), "a").join(right.select(F.col("pos").alias("b"), F.col("entities").alias("eb")), "b")
    shared, union = F.size(F.array_intersect("ea", "eb")), F.size(F.array_union("ea", "eb"))
    return both.select("a", "b", shared.alias("shared"), F.round(shared / F.greatest(union, F.lit(1)), 6).alias("overlap_ratio"))


def complete(wanted: DataFrame, found: DataFrame, group: str, item: str) -> DataFrame:
    """Groups of wanted(group, item) of which every item is in found(item); and how many are missing elsewhere."""
    marked = wanted.join(found.select(item).distinct().withColumn("there", F.lit(1)), item, "left")
    return marked.groupBy(group).agg(F.count("*").alias("n_items"), F.count_if(F.col("there").isNull()).alias("n_missing")).withColumn("complete", F.col("n_missing") == 0)


def confusion(selected: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of selected(key) against truth(key, positive); undefined ones are null."""
    joined = truth.join(selected.select(key).distinct().withColumn("chosen", F.lit(True)), key, "full")
    hit, want = F.coalesce("chosen", F.lit(False)), F.coalesce("positive", F.lit(False))
    counted = joined.agg(F.count_if(hit & want).alias("tp"), F.count_if(hit & ~want).alias("fp"), F.count_if(~hit & want).alias("fn"))
    precision, recall = F.expr("try_divide(tp, tp + fp)"), F.expr("try_divide(tp, tp + fn)")
    out = counted.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", F.round(F.expr("try_divide(2 * precision * recall, precision + recall)"), 6)).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))
