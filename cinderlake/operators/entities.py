"""Typed entities of normalized events, their index, and the entities that link incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.plans.hot import join_hot

#: Entity values without meaning, types that link events, and values too common to relate alerts.
IGNORED = ["-", "", "n/a", "none", "null", "unknown", "system", "0.0.0.0", "127.0.0.1", "::1"]
LINKING = ["USER", "HOST", "IP", "PROCESS", "ACCOUNT", "RESOURCE"]
GENERIC = ["host:idp.corp.test", "host:cloud-control-plane", "user:system", "user:-", "ip:0.0.0.0", "ip:127.0.0.1", "ip:::1"]


def entities_of() -> Column:
    """Entities of a normalized event as an array of (etype, evalue), in a fixed order, each once.

    Users, hosts and processes are compared in lower case; nulls and meaningless values are left out."""

    def one(kind: str, value) -> Column:
        return F.array(F.struct(F.lit(kind).alias("etype"), value.alias("evalue")))

    def many(kind: str, values: str, prefix: str = "") -> Column:
        return F.transform(F.coalesce(F.col(values), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("etype"), F.concat(F.lit(prefix), x).alias("evalue")))

    c = F.col
    found = F.concat(
        one("USER", F.lower(c("username"))), one("HOST", F.lower(c("hostname"))), one("IP", c("source_ip")), one("IP", c("destination_ip")), one("PROCESS", F.lower(c("process"))), one("ACCOUNT", c("account")),
        many("RESOURCE", "resources"), many("DETECTION", "detection_ids", "alert:"), many("DETECTION", "rule_ids", "rule:"), many("TECHNIQUE", "techniques"),
    )
    return F.array_distinct(F.filter(found, lambda e: e["evalue"].isNotNull() & ~F.lower(e["evalue"]).isin(IGNORED)))


def acting(entities: Column) -> Column:
    """The names (TYPE:value) of entities that are actors or assets."""
    return F.transform(F.filter(entities, lambda e: e["etype"].isin(LINKING)), lambda e: F.concat_ws(":", e["etype"], e["evalue"]))


def linking_names(names: str = "acting", listed: str = "listed") -> Column:
    """The names of entities that link events: those of acting(), and alerts of the array listed(etype, evalue)."""
    alerts = F.filter(listed, lambda e: (e["etype"] == "DETECTION") & e["evalue"].startswith("alert:"))
    return F.when(F.size(listed) > 0, F.concat(names, F.transform(alerts, lambda e: F.concat_ws(":", e["etype"], e["evalue"])))).otherwise(F.col(names))


def exploded(events: DataFrame) -> DataFrame:
    """(pos, event_id, t, etype, evalue, linking): one row an event and entity; alerts link as actors and assets do."""
    rows = events.select("pos", "event_id", "t", F.explode(entities_of()).alias("e")).select("pos", "event_id", "t", "e.*")
    return rows.withColumn("linking", F.col("etype").isin(LINKING) | ((F.col("etype") == "DETECTION") & F.col("evalue").startswith("alert:")))


def roles() -> list[Column]:
    """Which entity is the source address of an event and which its destination; null if it is none."""
    valid = lambda c: F.when(~F.lower(c).isin(IGNORED), F.col(c)).alias(f"{c}_entity")
    return [valid("source_ip"), valid("destination_ip")]


def linking_entities(events: DataFrame, hub_fraction: float | None = None, hub_least: int = 1000) -> DataFrame:
    """(entity, pos, t) of linking entities; with hub_fraction, those of more than max(hub_least, fraction of events) go."""
    rows = exploded(events).where("linking").select(F.concat_ws(":", "etype", "evalue").alias("entity"), "pos", "t")
    if hub_fraction is None:
        return rows
    most = events.agg(F.greatest(F.lit(float(hub_least)), hub_fraction * F.count("*")).alias("most"))
    sizes = rows.groupBy("entity").agg(F.count("*").alias("n"))
    hubs = sizes.join(F.broadcast(most), F.col("n") > F.col("most")).select("entity", F.lit(True).alias("hub"))
    return join_hot(rows, hubs, "entity", how="left").where("hub is null").drop("hub")


def statistics(events: DataFrame) -> DataFrame:
    """(etype, entities): distinct entities by type."""
    return exploded(events).select("etype", "evalue").distinct().groupBy("etype").agg(F.count("*").alias("entities"))


def incident_entities() -> Column:
    """Namespaced entities that relate alerts: hosts, people, addresses, cloud identities and resources.

    Services acting on their own are no actors; a source address must be an address; a few generic values are left out."""
    c, person = F.col, ~F.col("identity_type").eqNullSafe("AWSService")
    cloud = (c("category") == "cloud") & person
    name = lambda space, value, ok=F.lit(True): F.when(ok & (value != ""), F.concat(F.lit(space), value))
    address = c("source_ip").rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$")
    found = F.array(name("host:", c("hostname")), name("user:", c("username"), person), name("ip:", c("source_ip"), address), name("ip:", c("destination_ip")), name("principal:", c("principal_arn"), cloud), name("res:", c("resource"), cloud))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & ~x.isin(GENERIC)))
