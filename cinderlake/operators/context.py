"""Evidence items of a context pack: grouping, scores, ranks, entities, relationships, timeline and the token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.operators.correlation import TACTICS, tactic_of
from cinderlake.plans.hot import join_hot
from cinderlake.plans.stored import materialize, numbered

#: Least group that collapses, kept context items, kept items, relationships, entities, actors named.
COLLAPSE, CONTEXT_ITEMS, ITEMS, RELATIONSHIPS, ENTITIES, ACTORS = 3, 15, 60, 40, 40, 8
#: Points by severity 0 to 4, and seconds of the two gaps that count as near.
SEVERITY_POINTS, NEAR, CLOSE = [0, 1, 4, 7, 10], 1800, 300


def group_key() -> Column:
    """What events of one context item have in common; more for processes, names, connections and cloud calls."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    extra = F.when(F.col("category") == "process", F.concat_ws("|", c("hostname"), c("process"), c("parent_process"))).when(F.col("category").isin("dns", "network"), c("hostname")).when(F.col("category") == "cloud", c("principal_arn")).otherwise("")
    return F.concat_ws("|", F.col("seed").cast("string"), c("category"), c("action"), c("outcome"), c("source_ip"), c("destination_ip"), c("destination_port"), extra)


def items(events: DataFrame) -> DataFrame:
    """Evidence items of telemetry rows: groups of COLLAPSE or more events as one, all others as single events.

    Numbered from 1 (label E01 on) by first event; rare if their category and action occur twice at most."""
    named = ["category", "action", "outcome", "severity", "username", "hostname", "source_ip", "destination_ip", "process", "account", "resource", "principal_arn"]
    kept = ["pos", "t", "event_id", "seed", "rule_id", "technique", *named]
    # Columns are made once, behind inline(), though the key reads them again; those that only the key needs are not written.
    once = events.select(F.inline(F.array(F.struct(*kept, "destination_port", "parent_process"))))
    rows = materialize(once.select(*kept, group_key().alias("key")), "context-rows")
    sizes = rows.groupBy("key").agg(F.count("*").alias("group_size"))
    counts = rows.groupBy("category", "action").agg(F.count("*").alias("action_count"))
    first = F.min(F.struct("t", "event_id", *named)).alias("f")
    # One least event, one last time and two small sets a group: partial aggregates keep hot groups small.
    grouped = join_hot(rows, sizes, "key").groupBy("key", F.when(F.col("group_size") < COLLAPSE, F.col("pos")).alias("own")).agg(
        first, F.max("t").alias("last_t"), F.count("*").alias("n"), F.bool_or("seed").alias("detected"), F.array_sort(F.collect_set("rule_id")).alias("rules"), F.array_sort(F.collect_set("technique")).alias("techniques"),
    )
    # The first names of a group are picked before they are collected, so a burst over many accounts is no long list.
    place = F.row_number().over(Window.partitionBy("key").orderBy("username"))
    users = rows.where("username is not null").select("key", "username").distinct().withColumn("p", place).where(F.col("p") <= ACTORS)
    users = users.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list("username")).alias("actors"))
    grouped = grouped.join(users, F.col("own").isNull() & (F.col("key") == F.col("_key")), "left")
    actors = F.coalesce("actors", F.array_compact(F.array("f.username")))
    flat = grouped.select("key", "own", "f.*", "last_t", "n", "detected", "rules", "techniques", actors.alias("actors")).withColumnRenamed("t", "first_t")
    kinds = counts.withColumnsRenamed({"category": "_category", "action": "_action"})
    flat = flat.join(kinds, F.col("category").eqNullSafe(F.col("_category")) & F.col("action").eqNullSafe(F.col("_action"))).drop("_category", "_action")
    placed = numbered(flat, [F.asc("first_t"), F.asc("event_id")], "item")
    label = F.concat(F.lit("E"), F.lpad(F.col("item").cast("string"), F.greatest(F.lit(2), F.length(F.col("item").cast("string"))), F.lit("0")))
    out = placed.withColumn("id", label).withColumn("kind", F.when(F.col("n") > 1, "aggregate").otherwise("event")).withColumn("role", F.when(F.col("detected"), "detection_evidence").otherwise("context"))
    return materialize(out.withColumn("rarity", F.when(F.col("action_count") <= 2, "rare").otherwise("common")), "items")


def item_events(events: DataFrame, found: DataFrame) -> DataFrame:
    """(item, pos): which of the events each of the items() stands for; events may be some of those that the items were made of."""
    rows = events.select("pos", group_key().alias("key"))
    single = rows.select("pos").join(found.where("own is not null").select("item", F.col("own").alias("pos")), "pos").select("item", "pos")
    return single.unionByName(join_hot(rows, found.where("own is null").select("key", "item"), "key").select("item", "pos"))


def item_entities() -> Column:
    """Namespaced entities of an item, those of its first event and the actors it names."""
    one = lambda space, name: F.when(F.col(name) != "", F.concat(F.lit(f"{space}:"), F.col(name)))
    own = F.array(one("user", "username"), one("host", "hostname"), one("ip", "source_ip"), one("aws_account", "account"), one("aws_principal", "principal_arn"), one("process", "process"), one("ip", "destination_ip"), one("aws_resource", "resource"))
    more = F.when(F.col("n") > 1, F.transform("actors", lambda a: F.concat(F.lit("user:"), a))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(own, more)))


def near_detections(rows: DataFrame) -> DataFrame:
    """rows(item, first_t, ...) with near: 12 within CLOSE seconds of an item with detections, 6 within NEAR, else 0.

    Slots of CLOSE seconds with their least and greatest times say this without sorting all items in one task."""
    slot = CLOSE * 1_000_000
    times = rows.where(F.size("rules") > 0).groupBy(F.expr(f"first_t div {slot}").alias("s")).agg(F.min("first_t").alias("lo"), F.max("first_t").alias("hi"))
    reach = NEAR // CLOSE
    around = times.select("lo", "hi", "s", F.explode(F.sequence(F.col("s") - reach, F.col("s") + reach)).alias("at"))
    known = around.groupBy("at").agg(F.bool_or(F.col("s") == F.col("at")).alias("same"), F.min(F.when(F.col("s") > F.col("at"), F.col("lo"))).alias("next"), F.max(F.when(F.col("s") < F.col("at"), F.col("hi"))).alias("last"))
    gap = F.least(F.col("next") - F.col("first_t"), F.col("first_t") - F.col("last"))
    near = F.when(F.col("same") | (gap <= CLOSE * 1_000_000), 12).when(gap <= NEAR * 1_000_000, 6).otherwise(0)
    return rows.withColumn("at", F.expr(f"first_t div {slot}")).join(known, "at", "left").withColumn("near", near).drop("at", "same", "next", "last")


def scores(found: DataFrame) -> DataFrame:
    """Items with the six components of their evidence score and the total.

    Four linked items give all points, so of each entity's items the first five are enough to count them: where there are five, an
    item has four others at once; all other entities' lists are whole, hold the item itself, and are put together without pairs."""
    named = found.select("item", F.explode(item_entities()).alias("entity"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy("item"))
    few = named.withColumn("p", place).where("p <= 5").groupBy("entity").agg(F.collect_list("item").alias("some"))
    short = F.when(F.size("some") < 5, F.col("some"))
    met = join_hot(named, few, "entity").groupBy("item").agg(F.max(F.size("some")).alias("most"), F.collect_list(short).alias("lists"))
    others = met.select("item", F.when(F.col("most") == 5, 4).otherwise(F.size(F.array_distinct(F.flatten("lists"))) - 1).alias("linked"))
    rows = near_detections(found).join(others, "item", "left")
    stage = F.array_max(F.transform("techniques", lambda t: F.array_position(F.array(*map(F.lit, TACTICS)), tactic_of(t)) - 1))
    many = F.size("rules") > 0
    parts = {
        "detection_match": F.when(many, 40 + F.least(F.lit(10), 5 * (F.size("rules") - 1))).otherwise(0),
        "entity_link": F.least(F.lit(20), 5 * F.coalesce("linked", F.lit(0))),
        "temporal_relevance": F.when(many, 15).otherwise(F.col("near")),
        "attack_stage_relevance": F.coalesce(F.when(stage >= 0, F.bround(15 * stage / (len(TACTICS) - 1))), F.lit(0)),
        "severity_points": F.element_at(F.array(*map(F.lit, SEVERITY_POINTS)), F.col("severity") + 1),
        "rarity_points": F.when(F.col("rarity") == "rare", 5).otherwise(0),
    }
    out = rows.select(*found.columns, *[p.cast("int").alias(k) for k, p in parts.items()])
    return out.withColumn("total", sum((F.col(k) for k in parts), F.lit(0)))


def kept(scored: DataFrame, context_items: int = CONTEXT_ITEMS, most: int = ITEMS) -> DataFrame:
    """Items that stay, with their rank: all detection evidence and the best context items, `most` in all unless
    detection evidence alone is more."""
    best = [F.desc("total"), F.asc("first_t"), F.asc("item")]
    context = scored.where("role = 'context'").orderBy(*best).limit(context_items)
    evidence = scored.where("role <> 'context'")
    room = F.greatest(F.lit(0).cast("long"), most - F.count("*")).alias("room")
    place = F.row_number().over(Window.orderBy(*best))  # of `context_items` rows at most
    fitting = context.withColumn("p", place).join(F.broadcast(evidence.agg(room))).where("p <= room").drop("p", "room")
    return numbered(evidence.union(fitting), [F.desc("total"), F.asc("item")], "rank")


def entities(found: DataFrame, most: int = ENTITIES) -> DataFrame:
    """(entity, n_items, first_t, last_t, place): the entities of most items."""
    named = found.select("item", "first_t", "last_t", F.explode(item_entities()).alias("entity"))
    top = named.groupBy("entity").agg(F.count("*").alias("n_items"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t")).orderBy(F.desc("n_items"), "entity").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_items"), "entity")))  # of `most` rows


def relationships(found: DataFrame, top: DataFrame, most: int = RELATIONSHIPS) -> DataFrame:
    """(src, dst, via, delta): items that follow one another on one of the top entities, each pair once by the entity
    of most items; the `most` of least time between them, in whole seconds."""
    named = found.select("item", "first_t", "last_t", F.explode(item_entities()).alias("entity")).join(F.broadcast(top.select("entity", "place")), "entity")
    w = Window.partitionBy("entity").orderBy("first_t", "item")
    follow = named.withColumns({"dst": F.lead("item").over(w), "began": F.lead("first_t").over(w)}).where("dst is not null")
    once = follow.groupBy(F.col("item").alias("src"), "dst").agg(F.min(F.struct("place", "entity", ((F.col("began") - F.col("last_t")) / 1e6).cast("long").alias("delta"))).alias("m"))
    return once.select("src", "dst", F.col("m.entity").alias("via"), F.col("m.delta").alias("delta")).orderBy(F.abs("delta"), "src", "dst").limit(most)


def trim(packs: DataFrame, most_tokens: int) -> DataFrame:
    """(pack, item, tokens) of packs(pack, item, rank, role, chars): what stays when the worst-ranked context items go
    until the pack's text takes at most `most_tokens`; detection evidence never goes.

    Sizes add up, so the cut is where the running total of the items that may go first fits."""
    rank = F.when(F.col("role") == "context", F.col("rank")).otherwise(F.lit(0))
    w = Window.partitionBy("pack").orderBy(rank, "item").rowsBetween(Window.unboundedPreceding, 0)
    run = packs.withColumn("tokens", F.ceil(F.sum("chars").over(w) / 3.5))
    return run.where((F.col("role") != "context") | (F.col("tokens") <= most_tokens)).select("pack", "item", "tokens")
