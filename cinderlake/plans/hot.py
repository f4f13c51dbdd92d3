"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most frequent keys that are joined by broadcast: any other key has at most one in HOT_KEYS + 1 of the rows.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, unique: DataFrame, *keys: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined (inner or left) with `unique`, which has one row a key at most; a hot key's rows stay where they are.

    The HOT_KEYS most frequent keys of rows are found by a partial aggregate; their rows meet a broadcast of at most
    HOT_KEYS rows. Only the rest is dealt by key. rows and unique are read twice, so both should be cheap to read.
    counts(keys, n), if the rows of the keys have been counted already, spares another count. Null keys match nothing."""
    names = list(keys)
    if counts is None:
        counts = rows.where(" and ".join(f"{k} is not null" for k in names)).groupBy(*names).agg(F.count("*").alias("n"))
    hot = counts.orderBy(F.desc("n"), *names).limit(HOT_KEYS).select(*names, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), names, "left")
    hottest = F.broadcast(unique.join(F.broadcast(hot.select(*names)), names, "left_semi"))
    near = marked.where("_hot").drop("_hot").join(hottest, names, how)
    far = marked.where("_hot is null").drop("_hot").join(unique, names, how)
    return near.unionByName(far)
