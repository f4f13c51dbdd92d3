"""Sharding: a two-pass external shuffle that deals records to shards of equal row counts.

Pass one scatters records into memory-sized buckets by a seeded hash of their content. Pass two shuffles each
bucket (Spark's shuffle() is a Fisher-Yates shuffle) and numbers its records after those of the buckets before it.
Shard s takes the s-th run of consecutive numbers, so each shuffled bucket is written where it was shuffled,
without another exchange, and shard sizes differ by one row at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.llm.common import col

#: Mean bytes of a bucket: small against an executor's memory, as one task holds a bucket at a time.
BUCKET_BYTES = 8 << 20


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def external_shuffle(docs: DataFrame, n_shards: int, seed: int = 20240, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Deal all rows of docs(doc_id, text, ...) to n_shards shards.

    Returns record (a struct of all input columns), shard int and slot long (gapless from 0 in its shard). Null ids
    and texts, empty texts and repeated rows are records like any other; an empty table gives an empty result. The
    columns of docs stay inside the struct, so no name can clash. The hash takes id and text, hence rows that share
    only one of them scatter; a bucket is oversized only when very many rows are equal in both."""
    n_rows, n_bytes = docs.agg(F.count("*"), F.sum(record_size(col("text")))).first()
    buckets = max(1, math.ceil((n_bytes or 0) / bucket_bytes))
    key = F.xxhash64(F.lit(seed), col("doc_id"), F.crc32("text"), F.octet_length("text"))
    bucket = F.pmod(key, F.lit(buckets)).alias("bucket")
    ends = docs.select(bucket).groupBy("bucket").count()
    start = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("bucket", F.coalesce(start, F.lit(0)).alias("start"))
    scattered = docs.select(bucket, F.xxhash64(F.lit(seed + 1), key).alias("order"), F.struct(*[col(c) for c in docs.columns]).alias("record"))
    held = scattered.repartition("bucket").sortWithinPartitions("bucket", "order").groupBy("bucket").agg(F.collect_list("record").alias("records"))
    dealt = held.join(starts, "bucket").select("start", F.posexplode(F.shuffle("records", F.lit(seed))).alias("at", "record"))
    rank = F.col("start") + F.col("at")
    n = max(n_rows, 1)
    shard = F.expr(f"cast((start + at) * {n_shards} div {n} as int)")
    first = F.expr(f"(cast((start + at) * {n_shards} div {n} as bigint) * {n} + {n_shards - 1}) div {n_shards}")
    return dealt.select("record", shard.alias("shard"), (rank - first).alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write shuffled records as one folder per shard; bucket tasks write their own runs."""
    shuffled.write.partitionBy("shard").parquet(path)
