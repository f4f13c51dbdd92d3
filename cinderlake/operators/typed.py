"""Valid event documents: their flat fields, normalization, the detections that cite them, and what a context item shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.operators import normalize
from cinderlake.operators.documents import redacted_texts
from cinderlake.operators.validation import DETAILS, at, first_fault, is_object, kind_of, text_of
from cinderlake.plans.stored import materialize

#: Request parameters that name a resource, those that an item doesn't show, identities that are persons, and limits.
RESOURCE_PARAMETERS, HIDDEN, PERSONS, SHOWN_RESOURCES, LONGEST_TEXT = ["bucketName", "groupId", "roleArn"], ["description", "policyDocument"], ["IAMUser", "AWSAccount"], 5, 240


def detail(name: str) -> Column:
    """A detail field as a variant: of the event's own detail object, or else of the first other one that has it."""
    own = [F.when(text_of("category") == c, at(f"{k}.{name}")) for c, k in DETAILS.items()]
    return F.coalesce(*own, *[at(f"{k}.{name}") for k in DETAILS.values()])


def once(docs: DataFrame, *keys: str) -> DataFrame:
    """docs(*keys, v) with v named behind inline(), so that it isn't parsed anew for every field that is read of it."""
    return docs.select(*keys, F.inline(F.array(F.struct("v"))))


def texts_only(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", v)


def source_address() -> Column:
    """Where an event came from, as a variant: a detail, or else its host's own address; null unless it is a text."""
    return F.coalesce(texts_only(detail("source_ip")), texts_only(at("host.ip")))


def resource_names(v: str = "v", path: str = "$.cloud.resources") -> Column:
    """The texts among a cloud event's resources, in order."""
    items = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def normalized(docs: DataFrame) -> DataFrame:
    """docs(pos, v) of valid documents to the columns of normalize.normalized(), with the same limits and issues.

    Ids stay as they are. A cloud event's API call goes before its action; resources are its own and those that its request
    names, a port that is no whole number is none. Documents with a fault are dropped: rejected() has them. No shuffle."""
    valid = once(docs, "pos").where(first_fault().isNull())
    called = F.when(text_of("cloud.event_name") != "", at("cloud.event_name"))
    asked = F.array_compact(F.array(*[text_of(f"cloud.request_parameters.{p}") for p in RESOURCE_PARAMETERS]))
    whole = lambda v: F.when(F.schema_of_variant(v) == "BIGINT", v)
    found = {
        "timestamp": F.replace(text_of("timestamp"), F.lit(","), F.lit(".")).cast("variant"), "event_type": at("category"), "severity": at("severity"), "source": at("source"), "hostname": at("host.hostname"), "source_ip": source_address(), "destination_ip": texts_only(detail("destination_ip")),
        "source_port": detail("source_port"), "destination_port": whole(detail("destination_port")), "username": at("user.name"), "account": texts_only(at("cloud.account_id")), "process": texts_only(at("process.name")), "parent_process": texts_only(at("process.parent_name")), "command": texts_only(at("process.command_line")),
        "action": F.coalesce(called, at("action")), "status": at("outcome"), "technique": at("alert.technique_ids"), "resource": F.to_variant_object(F.concat(resource_names(), asked)),
    }
    full = lambda v: F.when(~F.is_variant_null(v), v)
    # Behind inline() each field is read once, whatever is built on it.
    read = F.struct(text_of("event_id").alias("given_id"), *[v.alias(f"_{n}") for n, v in found.items()])
    rows = valid.select("pos", F.inline(F.array(read)))
    rows = rows.select("pos", "given_id", *[(full(F.col(f"_{n}")) if n in found else F.lit(None).cast("variant")).alias(f"_{n}") for n in normalize.ALIASES])
    return normalize.coerced(rows, "given_id").withColumn("event_id", F.col("given_id")).drop("given_id")


def rejected(docs: DataFrame) -> DataFrame:
    """(pos, reason) of docs(pos, v) with a fault."""
    return once(docs, "pos").select("pos", F.inline(F.array(F.struct(first_fault().alias("reason"))))).where("reason is not null")


def with_detections(events: DataFrame, detections: DataFrame) -> DataFrame:
    """Normalized events with the ids, rules and techniques of the detections that cite them, after their own, each once.

    detections(place, event_id, detection_id, rule_id, techniques), techniques a list; place is their order. Values meet as
    rows with their first place, so a list grows with its distinct values only."""
    none = F.array().cast("array<string>")
    lists = {"detection_id": F.array("detection_id"), "rule_id": F.array("rule_id"), "technique": F.filter("techniques", lambda x: x.rlike(r"^T\d{4}(\.\d{3})?$"))}
    tagged = lambda n: lambda x, i: F.struct(F.lit(n).alias("list"), x.alias("value"), i.alias("at"))
    values = F.concat(*[F.transform(F.coalesce(v, none), tagged(n)) for n, v in lists.items()])
    firsts = detections.where("event_id is not null").select("event_id", "place", F.inline(values)).where("value is not null").groupBy("event_id", "list", "value").agg(F.min(F.struct("place", "at")).alias("first"))
    ordered = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == n, F.struct("first", "value")))), lambda x: x["value"]).alias(f"_{n}")
    cited = firsts.groupBy(F.col("event_id").alias("_id")).agg(*[ordered(n) for n in lists])
    met = events.join(cited, F.col("event_id") == F.col("_id"), "left")
    return met.withColumns({n: F.array_distinct(F.concat(n, F.coalesce(f"_{n}", none))) for n in lists}).drop("_id", *[f"_{n}" for n in lists])


def item_fields(docs: DataFrame, key: str, context: str, most: int = LONGEST_TEXT) -> DataFrame:
    """(key, context, fields, untrusted): what a context item shows of docs(key, context, place, v), as two JSON objects.

    `fields` holds what the source structured, keys in order, empty ones left out; `untrusted` holds free text, clipped to
    `most` characters after redaction. Names of persons, accounts and keys are pseudonyms of the context, numbered by place;
    texts lose secrets and known names, as redacted_texts() says. A destination without port ends in None. key is unique."""
    top = lambda p: f"_{p.split('.')[0]}"
    field = lambda p: at(p.split(".", 1)[1], top(p)) if "." in p else F.col(top(p))
    string = lambda v: F.try_variant_get(v, "$", "string")
    told = lambda v: string(texts_only(F.col(v)))
    # Step by step, each step's columns named once: a document has one or two of the detail objects, and what is absent is null at once for all its fields.
    flat, objects, names = ["category", "action", "outcome", "severity", "source"], ["host", "user", *DETAILS.values()], list(dict.fromkeys([key, context, "place"]))
    rows = once(docs, *names).select(F.col(key).alias("item_key"), F.col(context).alias("item_context"), "place", *[at(f).alias(f"_{f}") for f in [*flat, *objects]])
    rows = rows.select("item_key", "item_context", "place", *[told(f"_{f}").alias(f) for f in flat], *[f"_{f}" for f in objects])
    rows = rows.withColumn("_own", F.coalesce(*[F.when(F.col("category") == k, F.col(top(d))) for k, d in DETAILS.items()]))
    rows = rows.select("*", *[F.coalesce(*[at(n, f"_{d}") for d in ["own", *DETAILS.values()]]).alias(f"_{n}") for n in ("source_ip", "destination_ip", "destination_port")], F.schema_of_variant("_cloud").alias("_kind"), field("cloud.request_parameters").alias("_asked"))
    texts = {
        "api_call": "cloud.event_name", "service": "cloud.event_source", "identity_type": "cloud.identity_type", "account": "cloud.account_id", "principal": "cloud.principal_arn", "session_issuer": "cloud.session_issuer_arn", "access_key": "cloud.access_key_id", "minted_access_key": "cloud.response_elements.accessKeyId", "error_code": "cloud.error_code",
        "process": "process.name", "parent_process": "process.parent_name", "file_hash": "process.hash_sha256", "domain": "dns.query_name", "command_line": "process.command_line", "user_agent": "cloud.user_agent", "vendor_rule_name": "alert.rule_name", "role_description": "cloud.request_parameters.description",
    }
    scalars = {"host": "host.hostname", "username": "user.name", "vendor_rule": "alert.rule_id"}
    rows = rows.select("item_key", "item_context", "place", *flat, "_cloud", "_source_ip", "_destination_ip", "_destination_port", "_kind", "_asked", field("host.ip").alias("_host_ip"), field("cloud.mfa_authenticated").alias("_mfa"), *[field(v).alias(f"_{n}") for n, v in texts.items()], *[string(field(v)).alias(n) for n, v in scalars.items()])
    text = {n: told(f"_{n}") for n in texts} | {n: F.col(n) for n in scalars}
    text |= {"source_ip": string(F.coalesce(texts_only(F.col("_source_ip")), texts_only(F.col("_host_ip")))), "destination_ip": told("_destination_ip"), "destination_port": string(F.when(F.schema_of_variant("_destination_port") == "BIGINT", F.col("_destination_port")))}
    mfa = F.when(F.schema_of_variant("_mfa") == "BOOLEAN", F.try_variant_get("_mfa", "$", "boolean"))
    asked = F.from_json(F.when(is_object(F.schema_of_variant("_asked")), F.to_json("_asked")), "map<string,variant>")
    shown = F.map_filter(asked, lambda k, v: ~k.isin(HIDDEN) & ~F.is_variant_null(v) & ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"))
    cloudy = is_object(F.col("_kind")) & (F.col("_kind") != "OBJECT<>")
    read = [*[v.alias(n) for n, v in text.items()], mfa.alias("mfa"), F.slice(resource_names("_cloud", "$.resources"), 1, SHOWN_RESOURCES).alias("resources"), shown.alias("params"), cloudy.alias("cloudy")]
    rows = materialize(rows.select("item_key", "item_context", "place", *flat, *read), "shown")
    c = F.col
    person = c("identity_type").isNull() | c("identity_type").isin(PERSONS)
    # Which texts are redacted, and as what kind of identifier.
    named = {"actor": (F.when(person, c("username")), "USER"), "account": (c("account"), "AWS_ACCOUNT"), "access_key": (c("access_key"), "ACCESS_KEY"), "minted_access_key": (c("minted_access_key"), "ACCESS_KEY")}
    free = {n: (c(n), None) for n in ("principal", "session_issuer", "command_line", "user_agent", "role_description")}
    free |= {n: (F.when(c("category") == "alert", c(n)), None) for n in ("vendor_rule", "vendor_rule_name")}
    row = lambda path, value, kind: F.struct(path.alias("path"), value.alias("text"), kind.cast("string").alias("kind"))
    whole = F.array(*[row(F.lit(f".{n}"), v, F.lit(k)) for n, (v, k) in (named | free).items()])
    listed = F.transform("resources", lambda x, i: row(F.concat(F.lit(".resources["), i.cast("string"), F.lit("]")), x, F.lit(None)))
    given = F.filter(F.map_entries("params"), lambda e: F.schema_of_variant(e["value"]) == "STRING")
    given = F.transform(given, lambda e: row(F.concat(F.lit(".params."), e["key"]), F.try_variant_get(e["value"], "$", "string"), F.when(e["key"] == "userName", "USER")))
    parts = F.filter(F.concat(whole, listed, F.coalesce(given, F.array().cast("array<struct<path:string,text:string,kind:string>>"))), lambda x: x["text"] != "")
    texts = rows.select("item_key", "item_context", "place", F.inline(parts)).withColumn("id", F.concat_ws(" ", F.col("item_key").cast("string"), "path"))
    done, _ = redacted_texts(texts, "item_context")
    maps = done.groupBy(F.col("item_key").alias("_item")).agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("_m"))
    met = rows.join(maps, F.col("item_key") == F.col("_item"), "left")
    safe = lambda n: F.try_element_at("_m", F.lit(f".{n}"))
    when = lambda test, names, f=c: {n: F.when(test, f(n)) for n in names}
    out = {n: c(n) for n in ("category", "action", "outcome", "severity", "source", "host")} | {"actor": F.when(person, safe("actor")).otherwise(c("username")), "source_ip": F.when(c("source_ip").rlike("[0-9]"), c("source_ip"))}
    out["destination"] = F.when(c("destination_ip") != "", F.concat_ws(":", "destination_ip", F.coalesce("destination_port", F.lit("None"))))
    out |= when(c("cloudy"), ["api_call", "service", "identity_type", "error_code"]) | when(c("cloudy"), ["account", "principal", "session_issuer", "access_key", "minted_access_key"], safe)
    out |= when(c("category") == "process", ["process", "parent_process", "file_hash"]) | when(c("category") == "dns", ["domain"]) | {"vendor_rule": safe("vendor_rule")}
    values = {n: F.nullif(v, F.lit("")) for n, v in out.items()} | {"mfa": c("mfa")}
    numbers = F.transform("resources", lambda x, i: F.coalesce(F.try_element_at("_m", F.concat(F.lit(".resources["), i.cast("string"), F.lit("]"))), x))
    values["resources"] = F.when(F.size("resources") > 0, numbers)
    asked = F.transform(F.array_sort(F.map_keys("params")), lambda k: F.struct(k, F.coalesce(F.try_element_at("_m", F.concat(F.lit(".params."), k)).cast("variant"), F.element_at("params", k))))
    values["params"] = F.when(F.size("params") > 0, F.map_from_entries(asked))
    clipped = lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))
    raw = {n: clipped(safe(n)) for n in ("command_line", "role_description", "user_agent", "vendor_rule_name")}
    json = lambda values: F.to_json(F.struct(*[v.alias(n) for n, v in sorted(values.items())]), {"ignoreNullFields": "true"})
    return met.select(F.col("item_key").alias(key), F.col("item_context").alias(context), json(values).alias("fields"), json(raw).alias("untrusted"))
