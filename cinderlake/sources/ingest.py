"""Ingest and lookups: adapters to generic events, structured queries, stage predicates and checks between tables."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.functions.text import basename
from cinderlake.operators.correlation import TECHNIQUES
from cinderlake.plans.hot import join_hot
from cinderlake.sources.tables import key_values

#: Names of datasets as they may be called, in order of preference, and the most rows of a query.
DATASET_NAMES, MOST_ROWS = {"raw": ["raw_50k.jsonl", "raw.jsonl"], "siem": ["siem_50k.jsonl", "siem.jsonl"]}, 10_000


def dataset_path(kind: str, folder: str) -> str:
    """The first of a dataset's names that exists in a folder."""
    for name in DATASET_NAMES[kind]:
        if os.path.exists(path := os.path.join(folder, name)):
            return path
    raise FileNotFoundError(f"no {kind} dataset in {folder}")


def raw_to_generic(rows: DataFrame) -> DataFrame:
    """Raw records as (event_id, timestamp, host, event_type, message, source, severity); raw records have no severity."""
    return rows.select("event_id", "timestamp", "host", F.col("source_type").alias("event_type"), F.col("raw_message").alias("message"), F.col("source_file").alias("source"), F.lit(None).cast("int").alias("severity"))


def generic(rows: DataFrame) -> DataFrame:
    """Generic events with the fields of their message: names by preference, log-on failures by code or word."""
    f = lambda *names: F.coalesce(*[F.nullif(F.col("fields")[n], F.lit("")) for n in names])
    parsed = rows.withColumn("fields", key_values(F.coalesce("message", F.lit(""))))
    mail = F.when(F.contains(f("to"), F.lit("@")), F.substring_index(f("to"), "@", 1))
    connected = F.when(F.contains("message", F.lit("DeviceConnected")), "DeviceConnected")
    failed = F.coalesce(f("EventID") == "4625", F.lit(False)) | F.coalesce(F.upper(f("authentication")) == "FAILURE", F.lit(False))
    return parsed.select(
        "event_id", "timestamp", "event_type", "source", "severity", F.coalesce(F.nullif("host", F.lit("")), f("host", "device", "mailserver")).alias("host"), f("src", "client", "IpAddress", "SourceIp", "source_ip").alias("source_ip"),
        f("dst", "DestinationIp").alias("destination_ip"), f("sport").alias("source_port"), f("dport", "DestinationPort").alias("destination_port"), F.coalesce(f("user", "User", "AccountName"), mail).alias("username"),
        basename(f("Image")).alias("process_name"), basename(f("ParentImage")).alias("parent_process"), f("command", "request", "url", "uri").alias("command"), F.coalesce(f("action", "file_action"), F.concat(F.lit("EventID "), f("EventID")), connected).alias("action"),
        F.when(failed, "failure").otherwise(f("status", "Status", "authentication")).alias("status"), F.array_compact(F.array(f("path"), f("device_id"), f("query"))).alias("resource"), f("EventID").alias("event_code"), "message", "fields",
    )


def shape() -> dict[str, Column]:
    """What makes the shape of a generic event: type, code, action, process, and the command before its query."""
    path = F.substring_index(F.substring_index("command", "?", 1), " HTTP", 1)
    return {"event_type": F.col("event_type"), "event_code": F.col("event_code"), "action": F.col("action"), "process_name": F.col("process_name"), "path": path}


def category_of(event_type: Column, names: dict[str, str]) -> Column:
    """Category of a generic event type: by the given names, or the type itself, or other."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), event_type), event_type, F.lit("other"))


def split_columns(text: str) -> list[str]:
    """Expressions of a SELECT list, split at the commas outside parentheses, quotes and CASE."""
    out, depth, quoted, last = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "()":
            depth += 1 if ch == "(" else -1
        elif not quoted and not depth and ch == ",":
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


@dataclass(frozen=True)
class EventQuery:
    """A conjunction over events: an inclusive time range and lists of values; an empty list is no condition, and a null
    never is in a list."""

    start: int | None = None
    end: int | None = None
    hostname: Sequence[str] = field(default_factory=list)
    username: Sequence[str] = field(default_factory=list)
    category: Sequence[str] = field(default_factory=list)
    severity: Sequence[int] = field(default_factory=list)
    event_id: Sequence[str] = field(default_factory=list)
    limit: int = 1000

    def __post_init__(self):
        if not 1 <= self.limit <= MOST_ROWS:
            raise ValueError(f"limit must be 1 to {MOST_ROWS}")
        if self.start is not None and self.end is not None and self.start > self.end:
            raise ValueError("start is after end")

    def apply(self, events: DataFrame) -> DataFrame:
        rows = events
        if self.start is not None:
            rows = rows.where(F.col("t") >= self.start)
        if self.end is not None:
            rows = rows.where(F.col("t") <= self.end)
        for name in ("hostname", "username", "category", "severity", "event_id"):
            if values := getattr(self, name):
                rows = rows.where(F.col(name).isin(list(values)))
        return rows.orderBy("t", "pos").limit(self.limit)


def scenario_events(events: DataFrame, scenarios: DataFrame, key: str) -> DataFrame:
    """Events of a scenario of scenarios(key, event_id), in time order; keys are compared in lower case."""
    ids = scenarios.where(F.lower("key") == key.lower()).select("event_id")
    return events.join(ids, "event_id", "left_semi").orderBy("t", "pos")


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id).limit(1)


def vendor_alerts(events: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Events of category alert, with whether acknowledged(event_id) has them."""
    marks = acknowledged.select("event_id").distinct().withColumn("acknowledged", F.lit(True))
    return events.where("category = 'alert'").join(marks, "event_id", "left").withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))


def staged(events: DataFrame, stages: dict[str, str]) -> DataFrame:
    """One row an event and stage whose predicate it meets, in one pass: stage (from 0), name and the event's columns."""
    met = F.array_compact(F.array(*[F.when(F.expr(w), F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"))) for i, (n, w) in enumerate(stages.items())]))
    return events.select("*", F.inline(met))


def order_checks(rows: DataFrame) -> DataFrame:
    """By key: rows, those whose number follows the row before, and the share at which time runs backwards."""
    w = Window.partitionBy("key").orderBy("pos")
    steps = rows.withColumns({"step": F.col("pos") - F.lag("pos").over(w), "back": (F.col("t") < F.lag("t").over(w)).cast("int")})
    return steps.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("step") == 1).alias("adjacent"), F.round(F.coalesce(F.avg("back"), F.lit(0.0)), 6).alias("inversions"))


def compared(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that two tables share by key, and in how many of them each column is the same; nulls are the same."""
    other = right.select(key, *[F.col(c).alias(f"other_{c}") for c in columns])
    return left.join(other, key).agg(F.count("*").alias("both"), *[F.count_if(F.col(c).eqNullSafe(F.col(f"other_{c}"))).alias(f"same_{c}") for c in columns])


def within(groups: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in_scope): whether every element of groups(keys, evidence) is among chosen(pos)."""
    rows = groups.select(*keys, F.explode("evidence").alias("pos"))
    marks = chosen.select("pos").distinct().withColumn("there", F.lit(True))
    return join_hot(rows, marks, "pos", how="left").groupBy(*keys).agg(F.bool_and(F.col("there").isNotNull()).alias("in_scope"))


def summary() -> Column:
    """One line of an event from its structured fields; attacker-controlled text stays out."""
    where = F.coalesce("hostname", F.concat(F.lit("AWS account "), "account"), F.lit("unknown host"))
    base = F.concat("action", F.lit(" on "), where, F.lit(" as "), F.coalesce("username", F.lit("unknown user")))
    parent = F.coalesce(F.concat(F.lit(" (parent "), "parent_process", F.lit(")")), F.lit(""))
    more = F.when((F.col("category") == "process") & F.col("process").isNotNull(), F.concat(F.lit(": "), "process", parent)).when((F.col("category") == "network") & F.col("destination_ip").isNotNull(), F.concat(F.lit(": -> "), "destination_ip", F.lit(":"), F.col("destination_port").cast("string")))
    more = more.when(F.col("category") == "dns", ": DNS query [domain withheld]").when(F.col("category") == "alert", F.concat(F.lit(": rule "), F.coalesce("rule_id", F.lit("unknown")))).otherwise("")
    return F.concat(base, more)


def status(analysed: Column, pending: Column, reviewed: Column) -> Column:
    """Where a case stands."""
    return F.when(~analysed, "NEW").when(pending, "AWAITING_APPROVAL").when(reviewed, "RESPONSE_REVIEWED").otherwise("INVESTIGATING")


def split_techniques(ids: Column) -> tuple[Column, Column]:
    """Known and unknown technique ids, each once and in order."""
    known = F.array(*map(F.lit, TECHNIQUES))
    return F.array_distinct(F.filter(ids, lambda x: F.array_contains(known, x))), F.array_distinct(F.filter(ids, lambda x: ~F.array_contains(known, x)))
