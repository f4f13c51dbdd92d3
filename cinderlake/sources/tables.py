"""Table scans and bindings: raw tables to the columns that operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized events: pos, t (microseconds, whatever the session's time zone), user, k, type, severity, entities.

    purchase events are the detections (seed); severity 0 to 4 is the quarter of value below 100."""
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    out = raw.select(F.col("event_id").alias("pos"), F.expr(MICROS).alias("t"), "user_id", k.alias("k"), "event_type", "value", (F.col("event_type") == "purchase").alias("seed"))
    entities = F.array(F.concat(F.lit("U:"), F.col("user_id").cast("string")), F.concat(F.lit("K:"), F.col("k").cast("string")))
    return out.withColumn("severity", F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("value") / 25).cast("int")))).withColumn("entities", entities)


def json_dataset(spark: SparkSession, path: str, event_schema: str, version: str = "1.0.0") -> DataFrame:
    """Events of JSON documents with a header and an events array; another schema version is an error."""
    whole = spark.read.schema(f"schema_version string, events array<struct<{event_schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = whole.where(F.when(F.col("schema_version") == version, True).otherwise(F.raise_error(F.concat(F.lit("schema_version "), F.coalesce("schema_version", F.lit("missing"))))))
    return checked.select(F.explode("events").alias("e")).select("e.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines of text files with the split that they were read in and a rising number inside it."""
    meta = F.col("_metadata")
    return spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines that are neither blank nor JSON, with their number in their file, from 1; blank lines count.

    Files are cut into splits: lines are counted by split first, and the counts of a file's splits added up in their order. Only
    bad lines meet these counts, so good ones are read twice and shuffled never."""
    lines = text_lines(spark, path)
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    bad = lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull())
    return bad.join(splits, ["file", "block"]).select("file", (F.col("earlier") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line that isn't blank; a bad line fails the query of whoever reads it, and the error names file and line."""
    fault = F.format_string("%s, line %d: not JSON", "file", "line")
    first = bad_lines(spark, path).groupBy().agg(F.min_by(fault, F.struct("file", "line")).alias("_fault"))  # one row
    rows = text_lines(spark, path).where(F.trim("value") != "").join(F.broadcast(first))
    checked = F.when(F.col("_fault").isNull(), F.col("value")).otherwise(F.raise_error(F.col("_fault")).cast("string"))
    return rows.select(F.from_json(checked, schema).alias("r")).select("r.*")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels as JSON lines, attack_related renamed; critical rows must be related."""
    rows = json_lines(spark, path, "event_id string, attack_related boolean, attack_stage string, critical boolean")
    rows = rows.withColumnRenamed("attack_related", "is_attack_related")
    return rows.where(F.when(F.col("critical") & ~F.col("is_attack_related"), F.raise_error(F.concat(F.lit("critical but unrelated: "), "event_id"))).otherwise(True))


def siem_to_generic(rows: DataFrame) -> DataFrame:
    """SIEM records to the generic shape; the severity is a quarter of the rule level, 4 at most."""
    c = lambda *names: F.coalesce(*[F.col(n) for n in names])
    return rows.select(F.col("connector_event_id").alias("event_id"), c("timestamp", "_time").alias("timestamp"), c("host").alias("host"), c("decoder", "sourcetype").alias("source_type"), c("raw_message", "_raw").alias("raw_message"), F.least(F.lit(4), F.expr("level div 4").cast("int")).alias("severity"))


def key_values(message):
    """key=value and key="quoted value" pairs of a text as a map; the last occurrence of a key wins.

    Keys are letters, digits and underscores; a value ends at white space, or at the second quote if it begins with one. The address in
    "[client address]" counts as client unless a pair names one."""
    pattern = r'(?U)([A-Za-z_][A-Za-z0-9_]*)=("[^"]*"|\S+)'
    keys = F.regexp_extract_all(message, F.lit(pattern), F.lit(1))
    values = F.transform(F.regexp_extract_all(message, F.lit(pattern), F.lit(2)), lambda v: F.regexp_replace(v, '(?s)^"([^"]*)"$', "$1"))
    last = F.filter(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))
    client = F.regexp_extract(message, r"\[client ([0-9a-fA-F.:]+)\]", 1)
    more = F.when((client != "") & ~F.array_contains(keys, "client"), F.array(F.struct(F.lit("client").alias("key"), client.alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return F.map_from_entries(F.concat(last, more))
