"""The order of rows inside their conversations, found without gathering a conversation in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.llm.common import materialize


def in_order(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with _at (position in its key, from 0), _rows (rows of the key), _part and _apart, written.

    Range partitions hold runs of keys; a key over several of them (_apart) gets the counts of its earlier pieces from
    a table of at most two rows a boundary. Rows that are equal in key and order follow one another in any order, and
    null is a key like others. Within (_part, key) positions grow, and so they do with _part."""
    order = [*order, F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(F.col(key).asc_nulls_first(), *order)
    ranged = materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_part", key)
    pieces = ranged.groupBy("_part", key).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(key).orderBy("_part")
    apart = pieces.withColumn("_pieces", F.count("*").over(Window.partitionBy(key))).where("_pieces > 1")
    earlier = F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = apart.select(F.col("_part").alias("_p"), F.col(key).alias("_k"), earlier.alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("_all"))
    here = ranged.withColumn("_at", F.row_number().over(inside.orderBy(*order)) - 1).withColumn("_rows", F.count("*").over(inside))
    met = here.join(F.broadcast(apart), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    out = met.withColumn("_at", F.col("_at") + F.coalesce("_before", F.lit(0))).withColumn("_rows", F.coalesce("_all", "_rows"))
    return materialize(out.withColumn("_apart", F.col("_all").isNotNull()).drop("_p", "_k", "_before", "_all", "_tie"), "ordered")
