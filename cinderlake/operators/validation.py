"""Structural validation of event documents of unknown shape: the first fault of each, duplicates, counts, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.functions.policy import CATEGORIES, LEVELS, LONGEST, OUTCOMES
from cinderlake.plans.hot import join_hot
from cinderlake.plans.stored import materialize

#: Required fields in order (host isn't for cloud events), those that hold texts, and the detail object of each category.
REQUIRED, TEXTS = ["event_id", "timestamp", "source", "category", "action", "outcome", "severity", "host"], ["event_id", "source", "category", "action", "outcome", "severity"]
DETAILS = {"authentication": "auth", "process": "process", "network": "network", "dns": "dns", "alert": "alert", "cloud": "cloud"}
#: Notes on an event that are kept among its metadata.
ANNOTATIONS = ["scenario", "notes"]
#: Texts of values that stand for nothing, as a host's name.
EMPTY = ["null", '""', "0", "false", "[]", "{}"]
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?"
OFFSET = r"(Z|[+-]\d{2}:?\d{2}(:\d{2})?)"


def at(name: str, v: Column | str = "v") -> Column:
    """A field of a document as a variant; null only where it is absent."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind_of(name: str, v: Column | str = "v") -> Column:
    """The type of a field as text; null where it is absent."""
    return F.schema_of_variant(at(name, v))


def is_object(kind: Column) -> Column:
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def text_of(name: str, v: Column | str = "v") -> Column:
    """A text field; null where it is absent or something else."""
    return F.when(kind_of(name, v) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def first_fault(document: Column | str = "v") -> Column:
    """The first fault of an event document in a fixed order of checks; null for valid ones.

    Fields present, texts, vocabularies, host, user, detail object, raw text, metadata, time. Extended ISO 8601 times count as valid, but
    need an offset. Null documents and those that are no objects have a fault too."""
    kinds, texts = ["host", "user", "raw", "metadata", *dict.fromkeys([*DETAILS.values(), *REQUIRED])], [*TEXTS, "timestamp", "raw"]
    # Both lambdas are names: every field is read once, whatever the optimizer does with the checks.
    read = lambda v: F.struct(
        F.schema_of_variant(v).alias("whole"), F.struct(*[kind_of(k, v).alias(k) for k in dict.fromkeys(kinds)]).alias("kind"), F.struct(*[text_of(t, v).alias(t) for t in texts]).alias("text"), F.to_json(at("host.hostname", v)).alias("hostname"),
    )
    document = F.col(document) if isinstance(document, str) else document
    return F.get(F.transform(F.transform(F.array(document), read), _checked), F.lit(0))


def _checked(d: Column) -> Column:
    """The first fault of what first_fault() read of a document."""
    kind, text = d["kind"], d["text"]
    cloudy = F.coalesce(text["category"] == "cloud", F.lit(False)) | is_object(kind["cloud"])
    absent = F.concat_ws(", ", *[F.when(kind[f].isNull() & (F.lit(f != "host") | ~cloudy), F.lit(f)) for f in REQUIRED])
    checks = [F.when(~is_object(d["whole"]), "event must be an object"), F.when(absent != "", F.concat(F.lit("missing required field(s): "), absent))]
    for f in TEXTS:
        checks += [F.when(text[f].isNull() | (F.regexp_replace(text[f], r"(?U)^\s+|\s+$", "") == ""), f"field '{f}' must be a non-empty string"), F.when(F.length(text[f]) > LONGEST, f"field '{f}' is too long")]
    for f, known in (("category", CATEGORIES), ("severity", LEVELS), ("outcome", OUTCOMES)):
        checks.append(F.when(~text[f].isin(known), F.concat(F.lit(f"unknown {f} "), text[f])))
    other = lambda f: kind[f].isNotNull() & ~is_object(kind[f])
    checks += [F.when(other("host"), "host must be an object"), F.when(~cloudy & F.coalesce(d["hostname"], F.lit("null")).isin(EMPTY), "host must have a hostname"), F.when(other("user"), "user must be an object")]
    for category, key in DETAILS.items():
        checks.append(F.when((text["category"] == category) & (~is_object(kind[key]) | (kind[key] == "OBJECT<>")), f"category '{category}' needs an object '{key}'"))
    checks += [F.when(kind["raw"].isNotNull() & text["raw"].isNull(), "raw must be a string"), F.when(F.length(text["raw"]) > LONGEST, "raw is too long"), F.when(other("metadata"), "metadata must be an object")]
    time = text["timestamp"]
    valid = time.rlike(f"{ISO}{OFFSET}?)?$") & F.try_to_timestamp(F.replace(time, F.lit(","), F.lit("."))).isNotNull()
    checks += [F.when(time.isNull(), "timestamp must be a string"), F.when(~valid, "timestamp is not valid"), F.when(~time.rlike(f"{ISO}{OFFSET})$"), "timestamp must have an offset")]
    return F.coalesce(*checks)


def annotated() -> Column:
    """Metadata of an event as JSON: its own, and its annotations where they are texts and the metadata have none of that name."""
    own = F.when(is_object(kind_of("metadata")), F.to_json(at("metadata")))
    inside = F.coalesce(F.from_json(own, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    notes = F.array_compact(F.array(*[F.when(text_of(n).isNotNull() & at(f"metadata.{n}").isNull(), F.struct(F.lit(n).alias("key"), at(n).alias("value"))) for n in ANNOTATIONS]))
    return F.to_json(F.map_concat(inside, F.map_from_entries(notes)))


def other_details() -> Column:
    """Names of the detail objects of other categories that an event carries, in order."""
    own = F.element_at(F.create_map(*[F.lit(x) for kv in DETAILS.items() for x in kv]), text_of("category"))
    return F.array_compact(F.array(*[F.when(is_object(kind_of(k)) & (kind_of(k) != "OBJECT<>") & (F.coalesce(own, F.lit("")) != k), F.lit(k)) for k in DETAILS.values()]))


def batch_faults(docs: DataFrame) -> DataFrame:
    """(place, event_id, fault) of docs(place, v) with a fault, repeated ids included; place is the order in the batch.

    An id's first valid event stays, later valid ones are duplicates, as the batch is read in order."""
    judged = materialize(docs.select("place", text_of("event_id").alias("event_id"), first_fault().alias("fault")), "judged")
    firsts = judged.where("fault is null").groupBy("event_id").agg(F.min("place").alias("first"))
    marked = join_hot(judged, firsts, "event_id", how="left")
    again = F.when(F.col("place") > F.col("first"), "duplicate event_id in batch")
    without = judged.where("event_id is null").select("place", "event_id", "fault")
    known = marked.where("event_id is not null").select("place", "event_id", F.coalesce("fault", again).alias("fault"))
    return known.union(without).where("fault is not null")


def accepted(docs: DataFrame) -> DataFrame:
    """docs(place, v) if all of them are valid: the first fault of the batch fails the query of whoever reads it."""
    first = batch_faults(docs).groupBy().agg(F.min_by(F.concat_ws(": ", F.coalesce("event_id", F.lit("?")), "fault"), "place").alias("_fault"))
    return docs.join(F.broadcast(first)).where(F.when(F.col("_fault").isNull(), True).otherwise(F.raise_error(F.col("_fault")))).drop("_fault")  # one row


def counters(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(source, total, distinct_ids, duplicates, invalid, missing_<field> ...) of docs(place, v) by source; null for none.

    total less distinct_ids is what repeats ids; a field is missing if it is absent, null or blank. Events without an id are duplicates of nothing."""
    blank = lambda f: F.when(at(f).isNull() | F.is_variant_null(at(f)) | (F.trim(text_of(f)) == ""), 1).otherwise(0)
    rows = docs.select(text_of("source").alias("source"), text_of("event_id").alias("event_id"), first_fault().isNotNull().alias("bad"), *[blank(f).alias(f) for f in fields])
    per_id = rows.groupBy("source", "event_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), *[F.sum(f).alias(f) for f in fields])
    ids = F.count_if(F.col("event_id").isNotNull())
    return per_id.groupBy("source").agg(F.sum("n").alias("total"), ids.alias("distinct_ids"), (F.coalesce(F.sum(F.when(F.col("event_id").isNotNull(), F.col("n"))), F.lit(0).cast("long")) - ids).alias("duplicates"), F.sum("bad").alias("invalid"), *[F.sum(f).alias(f"missing_{f}") for f in fields])

