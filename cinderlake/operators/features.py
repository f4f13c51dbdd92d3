"""The 31 features of every event: its own, its cluster's, and those towards the nearest detection event."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.operators import graph, joins
from cinderlake.operators.entities import acting, entities_of, linking_names
from cinderlake.plans.hot import join_hot
from cinderlake.plans.stored import materialize, numbered

#: The columns in their order, states that count as failures, the distance without a reference.
FEATURES = [
    "severity", "detection_match", "detection_count", "technique_count", "event_frequency", "rarity", "entity_count", "status_failure",
    "degree", "cluster_size", "cluster_density", "cluster_has_detection", "cluster_detection_fraction", "event_type_similarity", "source_similarity",
    "same_user", "same_host", "same_source_ip", "same_destination_ip", "same_process", "same_account", "shared_detection", "shared_technique",
    "number_of_shared_entities", "entity_overlap_ratio",
    "timestamp_distance", "within_1_minute", "within_5_minutes", "within_15_minutes", "within_1_hour", "temporal_proximity",
]
FAILURES = ["failure", "failed", "denied", "blocked", "error", "fail"]
NO_REFERENCE = math.log1p(7 * 24 * 3600.0)
DECAY_SECONDS = 900.0


def references(events: DataFrame) -> DataFrame:
    """(pos, ref, distance in microseconds): the nearest detection event that shares an actor or asset.

    Where either has no time, the reference is the first timed detection event of an entity, or else the first untimed
    one, without a distance; of several entities the least position counts."""
    rows = events.select("pos", "t", F.col("detection_match").alias("seed"), F.explode("acting").alias("entity"))
    near = joins.nearest_seed(rows.where("t is not null"))
    if events.where("t is null").isEmpty():  # all that follows is about events without time
        return near
    seeds = rows.where("seed").groupBy("entity").agg(F.min(F.when(F.col("t").isNotNull(), F.struct("t", "pos"))).alias("timed"), F.min(F.when(F.col("t").isNull(), F.col("pos"))).alias("untimed"), F.count("t").alias("n"))
    first = rows.where("not seed").join(seeds, "entity").where("t is null or untimed is not null")
    # An untimed event prefers timed seeds; a timed one comes here for untimed seeds only.
    ways = F.when(F.col("t").isNull() & (F.col("n") > 0), F.struct(F.lit(0).alias("kind"), F.col("timed.pos").alias("ref"))).when(F.col("untimed").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("untimed").alias("ref")))
    late = first.groupBy("pos").agg(F.min(ways).alias("w")).where("w is not null").select("pos", F.col("w.ref").alias("far"))
    own = events.where("detection_match and t is null").select("pos", F.col("pos").alias("self"))
    out = events.select("pos").join(near, "pos", "left").join(late, "pos", "left").join(own, "pos", "left")
    return out.select("pos", F.coalesce("ref", "self", "far").alias("ref"), "distance").where("ref is not null")


def feature_matrix(normalized: DataFrame) -> DataFrame:
    """(pos, the 31 features as doubles) for every row of normalized events with unique pos."""
    c, flag = F.col, lambda x: x.cast("double")
    # Columns are made once, behind inline(); names and lists are read for entities alone, and not kept beside them.
    named = ["username", "hostname", "process", "account", "resources", "detection_ids", "rule_ids", "techniques"]
    kept = ["pos", "t", "event_type", "action", "status", "severity", "source", "source_ip", "destination_ip"]
    step = normalized.select(F.inline(F.array(F.struct(*kept, *named)))).select("*", entities_of().alias("entities"))
    listed = F.filter("entities", lambda e: e["etype"].isin("DETECTION", "TECHNIQUE"))
    step = step.select(*kept, acting(c("entities")).alias("acting"), listed.alias("listed"), F.size("entities").alias("n_entities"), F.size("techniques").alias("n_techniques"), (F.size("detection_ids") > 0).alias("detection_match"))
    events = materialize(step, "feature-events")
    n = events.agg(F.count("*").alias("n"))

    counts = events.groupBy(c("event_type").alias("of_type"), c("action").alias("of_action")).agg(F.count("*").alias("c"))
    own = events.join(F.broadcast(n)).join(counts, c("event_type").eqNullSafe(c("of_type")) & c("action").eqNullSafe(c("of_action"))).select(
        "pos", (c("severity") / 4).alias("severity"), flag(c("detection_match")).alias("detection_match"), "event_type", "source",
        F.log1p(F.size(F.filter("listed", lambda e: e["etype"] == "DETECTION"))).alias("detection_count"), F.log1p("n_techniques").alias("technique_count"),
        (c("c") / c("n")).alias("event_frequency"), (1 - F.log1p("c") / F.log1p("n")).alias("rarity"), flag(c("n_entities")).alias("entity_count"),
        flag(F.lower(F.coalesce("status", F.lit(""))).isin(FAILURES)).alias("status_failure"),
    )

    linked = materialize(graph.links(events.select("pos", "t", F.explode(linking_names()).alias("entity"))).drop("entity"), "feature-links")
    members = graph.linked_clusters(events, linked)
    # Ends of edges by event, counted once for its degree and for the edges of its cluster; a link's edges share their later end.
    end = lambda e, n, later: F.struct(e.alias("end"), n.alias("n"), later.alias("later"))
    both = F.array(end(c("pos"), F.size("before"), F.size("before")), *[end(F.get("before", F.lit(i)), F.lit(1), F.lit(0)) for i in range(graph.NEIGHBOURS)])
    ends = linked.select(F.inline(both)).where("end is not null").groupBy("end").agg(F.sum("n").alias("ends"), F.sum("later").alias("later"))
    placed = materialize(own.join(members, "pos").join(ends, c("pos") == c("end"), "left").drop("end"), "feature-clusters")
    # What an event's cluster adds depends on cluster, type and source only: worked out once for each of these.
    kinds = placed.groupBy("cluster", "event_type", "source").agg(F.count("*").alias("n"), F.sum("detection_match").alias("hits"), F.coalesce(F.sum("later"), F.lit(0)).alias("edges"))
    kinds = materialize(kinds, "feature-kinds")
    wholes = kinds.groupBy("cluster").agg(F.sum("n").alias("size"), F.sum("hits").alias("hits"), F.sum("edges").alias("edges"))
    share = lambda column, name: kinds.groupBy("cluster", column).agg(F.sum("n").alias(name)).select(c("cluster").alias(f"{name}_c"), c(column).alias(f"{name}_k"), name)
    types, sources = share("event_type", "same_type"), share("source", "same_source")
    shares = kinds.select("cluster", "event_type", "source").join(wholes, "cluster").join(types, (c("cluster") == c("same_type_c")) & c("event_type").eqNullSafe(c("same_type_k"))).join(sources, (c("cluster") == c("same_source_c")) & c("source").eqNullSafe(c("same_source_k")))
    shares = shares.select(
        c("cluster").alias("_cluster"), c("event_type").alias("_type"), c("source").alias("_source"), F.log10("size").alias("cluster_size"), (c("edges") / c("size")).alias("cluster_density"), flag(c("hits") > 0).alias("cluster_has_detection"),
        (c("hits") / c("size")).alias("cluster_detection_fraction"), (c("same_type") / c("size")).alias("event_type_similarity"), (c("same_source") / c("size")).alias("source_similarity"),
    )
    cluster = placed.withColumn("degree", F.log1p("ends")).join(shares, (c("cluster") == c("_cluster")) & c("event_type").eqNullSafe(c("_type")) & c("source").eqNullSafe(c("_source")))

    listed = events.select("pos", F.inline("listed"))
    postings = listed.groupBy("etype", "evalue").agg(F.count("*").alias("posting"))
    shared = join_hot(listed, postings, "etype", "evalue").groupBy("pos").agg(
        F.log1p(F.max(F.when(c("etype") == "DETECTION", c("posting") - 1))).alias("shared_detection"), flag(F.max((c("etype") == "TECHNIQUE") & (c("posting") > 1))).alias("shared_technique"),
    )

    valid = lambda a: F.when(F.array_contains("acting", F.concat(F.lit("IP:"), c(a))), c(a)).alias(a)
    side = events.select("pos", "acting", valid("source_ip"), valid("destination_ip"))
    pairs = references(events).join(side, "pos").join(side.select(*[c(x).alias(f"ref_{x}") for x in side.columns]), c("ref") == c("ref_pos"))
    both = pairs.withColumn("common", F.array_intersect("acting", "ref_acting")).withColumn("d", c("distance") / 1e6)
    same = lambda kind: flag(F.exists("common", lambda x: x.startswith(f"{kind}:"))).alias(f"same_{kind.lower()}")
    equal = lambda a: flag(F.coalesce(c(a) == c(f"ref_{a}"), F.lit(False))).alias(f"same_{a}")
    within = lambda s, name: flag(F.coalesce(c("d") <= s, F.lit(False))).alias(f"within_{name}")
    towards = both.select(
        "pos", same("USER"), same("HOST"), same("PROCESS"), same("ACCOUNT"), equal("source_ip"), equal("destination_ip"), flag(F.size("common")).alias("number_of_shared_entities"),
        F.coalesce(F.expr("try_divide(size(common), size(array_union(acting, ref_acting)))"), F.lit(0.0)).alias("entity_overlap_ratio"),
        F.coalesce(F.log1p("d"), F.lit(NO_REFERENCE)).alias("timestamp_distance"), within(60, "1_minute"), within(300, "5_minutes"), within(900, "15_minutes"), within(3600, "1_hour"),
        F.coalesce(F.exp(-c("d") / DECAY_SECONDS), F.lit(0.0)).alias("temporal_proximity"),
    )

    out = cluster.join(shared, "pos", "left").join(towards, "pos", "left")
    filled = {f: NO_REFERENCE if f == "timestamp_distance" else 0.0 for f in FEATURES}
    return out.select("pos", *[F.coalesce(F.col(f).cast("double"), F.lit(v)).alias(f) for f, v in filled.items()])


def numbered_clusters(events: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, number, label, first_t): clusters in the order of their earliest event, then of its id; C00001 on.

    Clusters without a time come last; labels have as many digits as the number of clusters, five at least."""
    firsts = events.select("pos", "t", "event_id").join(members, "pos").groupBy("cluster").agg(F.min(F.struct(F.coalesce("t", F.lit(2**62)).alias("t"), "event_id")).alias("f"))
    placed = numbered(firsts.select("cluster", "f.*"), [F.asc("t"), F.asc("event_id")], "number")
    digits = firsts.agg(F.greatest(F.lit(5), F.length(F.count("*").cast("string"))).alias("digits"))
    label = F.concat(F.lit("C"), F.lpad(F.col("number").cast("string"), F.col("digits"), F.lit("0")))
    return placed.join(F.broadcast(digits)).select("cluster", "number", label.alias("label"), F.when(F.col("t") < 2**62, F.col("t")).alias("first_t"))
