"""Written intermediate tables and global numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cinderlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders and tables that this driver wrote, oldest first; None where discarded.
_written: list[str | None] = []


def written() -> int:
    """How many intermediate tables were written so far: a mark for discard()."""
    return len(_written)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors and lets several later steps read one result."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write df as a table bucketed by key, so that joins by it need no further exchange."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    _written.append(table)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def discard(spark: SparkSession, first: int, last: int) -> None:
    """Delete the intermediate tables from mark first to mark last; nothing may read them any more."""
    for i in range(first, last):
        item, _written[i] = _written[i], None
        if item and "/" in item:
            path = spark._jvm.org.apache.hadoop.fs.Path(item)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        elif item:
            spark.sql(f"DROP TABLE IF EXISTS {item}")


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go before the next large shuffle.

    Spark removes them once the driver's JVM has collected the plans that wrote them, which an idle driver puts off."""
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """df with a gapless number from 1 in a total order, without gathering rows in one task.

    Range partitions are numbered inside; only one count a partition is added up."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_at", inside).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
