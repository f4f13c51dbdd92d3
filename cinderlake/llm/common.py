"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cinderlake.operators.graph import connected_components
from cinderlake.plans.hot import join_hot
from cinderlake.plans.stored import bucketed, discard, materialize, numbered, release, shared_dir, written

__all__ = ["WORD", "WORD_GAP", "bucketed", "col", "connected_components", "discard", "id_crc_mod", "join_hot", "materialize", "numbered", "release", "shared_dir", "small_batches", "words", "written"]

#: Separators between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch; whole texts may be long, so batches are short.
ARROW_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for an executor's Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """All words of a text as an array; none for a null text."""
    return F.coalesce(F.array_remove(F.split(text, WORD_GAP), ""), F.array().cast("array<string>"))


def id_crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus
