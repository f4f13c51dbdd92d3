"""Buckets of time, so that no task needs all rows of a key. Times are whole microseconds in a column t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket is this many times as long as the window that looks back from its rows.
WINDOWS_A_BUCKET = 8
#: Length of a bucket where nothing bounds how far to look.
DAY = 86_400_000_000


def bucket_of(t: Column, width: int) -> Column:
    """Number of the bucket of a time; null without a time."""
    return ((t - F.pmod(t, F.lit(width))) / width).cast("long")


def looking_back(rows: DataFrame, span: int) -> DataFrame:
    """rows with bucket and own: each row in its own bucket and, own false, in the next one if that begins within span.

    A bucket then holds all that its own rows can see in a closed window of that span."""
    width = WINDOWS_A_BUCKET * span
    here = bucket_of(F.col("t"), width)
    place = lambda b, own: F.struct(b.alias("bucket"), F.lit(own).alias("own"))
    both = F.when(F.pmod("t", F.lit(width)) >= width - span, F.array(place(here, True), place(here + 1, False))).otherwise(F.array(place(here, True)))
    return rows.withColumn("_place", F.explode(both)).select(*rows.columns, "_place.bucket", "_place.own")


def carried(rows: DataFrame, key: str, values: dict[str, Column], over: dict[str, tuple[Column, str]]) -> DataFrame:
    """(key_, bucket_, ...): what other buckets of a key hand to each of its buckets, one row a bucket.

    values are aggregates of rows(key, bucket); of them, over names what a bucket gets: an aggregate over the buckets
    `before` or `after` it. Rows without time make a bucket (null) before all others."""
    one = rows.groupBy(F.col(key).alias("key_"), F.col("bucket").alias("bucket_")).agg(*[v.alias(n) for n, v in values.items()])
    w = Window.partitionBy("key_")
    ways = {"before": w.orderBy(F.asc("bucket_")), "after": w.orderBy(F.desc("bucket_"))}
    got = [v.over(ways[way].rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n, (v, way) in over.items()]
    return one.select("key_", "bucket_", *got)


def same_bucket(key: str) -> Column:
    """Join condition of rows with what is carried to them; nulls meet nulls."""
    return F.col(key).eqNullSafe(F.col("key_")) & F.col("bucket").eqNullSafe(F.col("bucket_"))
