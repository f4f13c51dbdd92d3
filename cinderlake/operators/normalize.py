"""Normalization of JSON events of unlike shapes to one set of typed columns, with the issues found on the way."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TEXT = 512
#: Where each field may be found, in order of preference, and the ranks of severity names.
ALIASES = {
    "event_id": ["event_id", "id", "eventID", "event.id", "_id", "uid"],
    "timestamp": ["timestamp", "@timestamp", "time", "ts", "eventTime", "event_time", "event.created"],
    "event_type": ["event_type", "category", "eventType", "type", "event.category"],
    "severity": ["severity", "level", "priority", "event.severity"],
    "source": ["source", "log_source", "sourcetype", "provider", "event.provider"],
    "hostname": ["hostname", "host.hostname", "host.name", "computer", "device", "host"],
    "source_ip": ["source_ip", "src_ip", "src", "sourceIPAddress", "client_ip", "source.ip", "auth.source_ip", "network.source_ip", "cloud.source_ip"],
    "destination_ip": ["destination_ip", "dest_ip", "dst_ip", "dst", "destination.ip", "network.destination_ip"],
    "source_port": ["source_port", "src_port", "sport", "source.port", "network.source_port"],
    "destination_port": ["destination_port", "dest_port", "dst_port", "dport", "destination.port", "network.destination_port"],
    "username": ["username", "user_name", "user.name", "userIdentity.userName", "account_name", "user"],
    "account": ["account", "account_id", "recipientAccountId", "cloud.account_id", "cloud.account.id"],
    "process": ["process_name", "process.name", "image", "process"],
    "parent_process": ["parent_process", "parent_process_name", "parent_image", "process.parent_name"],
    "command": ["command", "command_line", "cmdline", "process.command_line"],
    "action": ["action", "eventName", "event_name", "operation", "event.action"],
    "status": ["status", "outcome", "result", "event.outcome"],
    "detection_id": ["detection_id", "alert_id", "detection_ids", "alert_ids"],
    "rule_id": ["rule_id", "rule", "signature_id", "rule_ids", "rule.id"],
    "technique": ["technique", "technique_id", "mitre_technique", "technique_ids", "mitre", "alert.technique_ids"],
    "resource": ["resource", "resources", "cloud.resources", "resource_id", "bucketName", "cloud.request_parameters.bucketName"],
}
SEVERITIES = {"informational": 0, "info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}

TEXTS = ["event_id", "event_type", "source", "hostname", "username", "account", "process", "parent_process", "command", "action", "status"]
LISTS = ["detection_id", "rule_id", "resource"]


@F.pandas_udf(T.StringType())
def _long_address(values: pd.Series) -> pd.Series:
    """Canonical IPv6 text, null where it isn't one; only rows with a colon carry a value."""

    def canonical(v: str | None) -> str | None:
        try:
            return str(ipaddress.IPv6Address(v)) if v else None
        except ValueError:
            return None

    return values.map(canonical)


#: Top-level keys that some alias begins with; literal dotted keys too.
HEADS = list(dict.fromkeys(h for aliases in ALIASES.values() for a in aliases for h in (a, a.split(".", 1)[0])))


def looked_up(name: str) -> Column:
    """The first alias that holds a value other than null; a literal dotted key goes before the nested path.

    The row's top-level keys are columns h_<number in HEADS>, so only nested paths walk a variant."""
    head = {h: F.col(f"h_{i}") for i, h in enumerate(HEADS)}
    full = lambda v: F.when(v.isNotNull() & ~F.is_variant_null(v), v)
    found = []
    for alias in ALIASES[name]:
        found.append(full(head[alias]))
        if "." in alias:
            top, rest = alias.split(".", 1)
            found.append(F.when(head[top].isNotNull(), full(F.try_variant_get(head[top], f"$.{rest}", "variant"))))
    return F.coalesce(*found)


def kind(value: Column) -> Column:
    """'text', 'number', 'list' or 'other' (a boolean or an object); null for null."""
    kinds = {"STR": "text", "BIG": "number", "DEC": "number", "DOU": "number", "FLO": "number", "ARR": "list"}
    known = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(known, F.substring(F.schema_of_variant(value), 1, 3)), F.lit("other")))


def as_text(value: Column) -> Column:
    return F.nullif(F.btrim(F.try_variant_get(value, "$", "string"), F.lit(" \t\n\x0b\x0c\r")), F.lit(""))


def object_text(raw: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(raw.rlike(r"^\s*\{") & F.try_parse_json(raw).isNotNull(), F.lit(False))


def normalized(rows: DataFrame) -> DataFrame:
    """rows(pos, raw), raw a JSON object as text, to typed columns and issues; other columns of rows are dropped.

    Rows whose raw isn't a JSON object are left to rejected(). Texts are trimmed and clipped to 512 characters, lists
    keep first occurrences in order, a number of 1e11 or more is a time in milliseconds, a time without offset is UTC.
    A row without id becomes anon-<pos>. A projection without shuffle; only IPv6 addresses go through Arrow."""
    # One parse into the keys that some alias names, each a variant of its own; what isn't an object fails the cheaper test.
    schema = T.StructType([T.StructField(h, T.VariantType()) for h in HEADS])
    valid = rows.where(object_text(F.col("raw")))
    parsed = valid.select("pos", F.from_json("raw", schema).alias("_e")).select("pos", *[F.col(f"_e.`{h}`").alias(f"h_{i}") for i, h in enumerate(HEADS)])
    return coerced(parsed.select("pos", *[looked_up(n).alias(f"_{n}") for n in ALIASES]))


def coerced(found: DataFrame, *keep: str) -> DataFrame:
    """found(pos, *keep, _<name> ...), a variant for every name in ALIASES, to typed columns and issues, as normalized() says."""
    # Kinds and texts are named once, behind inline(): filters and projections above it would otherwise be pushed
    # down with all lookups written out again in every place.
    named = [F.col(f"_{n}") for n in ALIASES] + [kind(F.col(f"_{n}")).alias(f"_k_{n}") for n in ALIASES] + [as_text(F.col(f"_{n}")).alias(f"_t_{n}") for n in ALIASES]
    found = found.select("pos", *keep, F.inline(F.array(F.struct(*named))))
    out, issues = {}, []
    plain = lambda n: F.col(f"_k_{n}").isin("text", "number")
    text = lambda n: F.col(f"_t_{n}")
    for n in TEXTS:
        out[n] = F.when(plain(n), F.substring(text(n), 1, MAX_TEXT))
        issues += [F.when(F.col(f"_k_{n}").isNotNull() & ~plain(n), f"invalid_type:{n}"), F.when(plain(n) & (F.length(text(n)) > MAX_TEXT), f"truncated:{n}")]
    out["event_id"] = F.coalesce(out["event_id"], F.format_string("anon-%06d", "pos"))
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    for n in ("source_ip", "destination_ip"):
        given = F.when(F.col(f"_k_{n}") == "text", text(n))
        out[n] = F.when(given.rlike(rf"^{octet}(\.{octet}){{3}}$"), given).otherwise(_long_address(F.when(F.contains(given, F.lit(":")), given)))
    for n in ("source_port", "destination_port"):
        number = F.when(plain(n), F.coalesce(F.when(F.col(f"_k_{n}") == "number", F.try_variant_get(f"_{n}", "$", "double").cast("long")), text(n).try_cast("long")))
        out[n] = F.when(number.between(0, 65535), number.cast("int"))
    names = F.create_map(*[F.lit(x) for item in SEVERITIES.items() for x in item])
    digits = F.when(text("severity").rlike("^[0-9]+$"), F.least(F.lit(4), F.coalesce(text("severity").try_cast("int"), F.lit(4))))
    number = F.greatest(F.lit(0), F.least(F.lit(4), F.try_variant_get("_severity", "$", "double").cast("int")))
    rank = F.when(F.col("_k_severity") == "number", number).when(F.col("_k_severity") == "text", F.coalesce(F.try_element_at(names, F.lower(text("severity"))), digits))
    out["severity"] = F.coalesce(rank, F.lit(0))
    stamp = F.try_variant_get("_timestamp", "$", "double")
    seconds = F.when(stamp > 1e11, stamp / 1000).otherwise(stamp)
    zoned = F.when(text("timestamp").rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), text("timestamp")).otherwise(F.concat(text("timestamp"), F.lit("Z")))
    iso = F.when(text("timestamp").rlike(r"^\d{4}-\d\d-\d\d"), zoned.try_cast("timestamp"))
    out["timestamp"] = F.when(F.col("_k_timestamp") == "number", F.timestamp_micros(F.round(seconds * 1e6).cast("long"))).when(F.col("_k_timestamp") == "text", iso)
    items = lambda n: F.when(F.col(f"_k_{n}") == "list", F.try_variant_get(f"_{n}", "$", "array<variant>")).when(F.col(f"_k_{n}").isNotNull(), F.array(f"_{n}"))
    words = lambda n: F.array_distinct(F.array_compact(F.transform(items(n), lambda v: F.when(kind(v).isin("text", "number"), F.substring(as_text(v), 1, MAX_TEXT)))))
    none = F.array().cast("array<string>")
    for n in LISTS:
        out[n] = F.coalesce(words(n), none)
    technique = F.transform(words("technique"), lambda x: F.upper(x))
    out["technique"] = F.coalesce(F.array_distinct(F.filter(technique, lambda x: x.rlike(r"^T\d{4}(\.\d{3})?$"))), none)
    issues.append(F.when(F.col("_k_severity").isNotNull() & rank.isNull(), "invalid_severity"))
    step = found.select("pos", *keep, *[out[n].alias(n) for n in ALIASES], *[f"_k_{n}" for n in ALIASES], F.array_compact(F.array(*issues)).alias("_issues"))
    bad = [F.when(F.col(f"_k_{end}_{what}").isNotNull() & F.col(f"{end}_{what}").isNull(), f"invalid_{what}:{end}_{what}") for what in ("ip", "port") for end in ("source", "destination")]
    untimed = F.when(F.col("_k_timestamp").isNull(), "missing:timestamp").when(F.col("timestamp").isNull(), "invalid:timestamp")
    return step.select("pos", *keep, *ALIASES, F.concat("_issues", F.array_compact(F.array(*bad, untimed))).alias("issues"))


def rejected(rows: DataFrame) -> DataFrame:
    """(pos, reason) of rows whose raw isn't a JSON object."""
    parsed = F.try_parse_json("raw")
    why = F.when(F.col("raw").isNull(), "missing").when(parsed.isNull(), "not_json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_an_object")
    return rows.select("pos", why.alias("reason")).where(F.col("reason").isNotNull())


def report(events: DataFrame) -> DataFrame:
    """(issue, n) over all normalized events."""
    return events.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
