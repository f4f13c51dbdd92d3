"""Entities, links in time, connected components and their statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.plans.buckets import looking_back
from cinderlake.plans.hot import join_hot
from cinderlake.plans.stored import materialize

#: Seconds of a link and earlier neighbours per entity.
LINK_SECONDS, NEIGHBOURS = 3600, 3
#: Pairs that are reported, and items of a group up to which all its pairs are counted at once.
TOP_PAIRS, SMALL_GROUP = 40, 64
#: Rows of small groups whose pairs one task counts.
PART_ROWS = 1_000_000


def contracted(edges: DataFrame, portion: int = 1_000_000, centres: bool = False) -> DataFrame:
    """(a, b) with a > b: the edges of each portion replaced by a star around every component in it.

    What a portion connects stays connected, in at most as many edges, and a task holds one portion at a time. With centres,
    (b, b) of every star's centre too."""

    def star(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while len(x):
            p, q = label[x], label[y]
            open_ = p != q
            x, y, p, q = x[open_], y[open_], p[open_], q[open_]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label != (up := label[label])).any():
                label = up
        leaf = np.arange(len(nodes)) if centres else np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[label[leaf]])], names=["a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= portion:
                yield star(*map(np.concatenate, zip(*held)))
                held, rows = [], 0
        if held:
            yield star(*map(np.concatenate, zip(*held)))

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is its smallest reachable node.

    Every round contracts the edges of each partition by themselves and, while stars still touch one another, does a
    large-star and a small-star step between partitions. A node's least neighbour comes from a partial aggregate. Few edges lie
    in one partition and are done after one round. Null ends and loops are ignored; repeated edges are harmless; an
    empty input gives an empty result."""
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    for _ in range(max_rounds):
        # Contracted before the edges are dealt by their larger ends, and again after it.
        pairs = materialize(contracted(contracted(pairs).repartition("a")), "stars")
        # Done if stars touch no other one: every leaf has one centre, and no centre is a leaf.
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("x"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
        touched = ends.groupBy("x").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("centre")).where("leaves > 1 or (leaves = 1 and centre = 0)")
        if touched.limit(1).count() == 0:
            break
        both = pairs.union(pairs.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = join_hot(both, low, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        pairs = materialize(star.selectExpr("greatest(e.a, e.b) a", "least(e.a, e.b) b").where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.selectExpr("b", "b").distinct())


def event_entities(events: DataFrame) -> DataFrame:
    """(pos, t, entity) of normalized events(pos, t, entities array); ignored and repeated values are gone."""
    ignored = ["-", "", "n/a", "none", "null", "unknown", "system", "0.0.0.0", "127.0.0.1", "::1"]
    named = F.filter("entities", lambda e: e.isNotNull() & ~F.lower(F.substring_index(e, ":", -1)).isin(ignored))
    return events.select("pos", "t", F.explode(F.array_distinct(named)).alias("entity"))


def links(entities: DataFrame, seconds: int = LINK_SECONDS, k: int = NEIGHBOURS) -> DataFrame:
    """(entity, pos, t, before): events with the positions of their k latest predecessors on an entity within the time, the latest first.

    Events without any have no row, nor have events without time."""
    span = seconds * 1_000_000
    w = Window.partitionBy("entity", "bucket").orderBy("t", "pos")
    before = F.array_compact(F.array(*[F.when(F.col("t") - F.lag("t", i).over(w) <= span, F.lag("pos", i).over(w)) for i in range(1, k + 1)]))
    found = looking_back(entities.where("t is not null"), span).withColumn("before", before)
    return found.where("own and size(before) > 0").select("entity", "pos", "t", "before")


def link_edges(entities: DataFrame, seconds: int = LINK_SECONDS, k: int = NEIGHBOURS) -> DataFrame:
    """(entity, src, dst): each event with its k latest predecessors on an entity within the time.

    One edge per shared entity, so two events that share two entities have two edges. Events without time have none."""
    return links(entities, seconds, k).select("entity", F.explode("before").alias("src"), F.col("pos").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(pos, degree): endpoints of edges, by event."""
    return edges.select(F.explode(F.array("src", "dst")).alias("pos")).groupBy("pos").agg(F.count("*").alias("degree"))


def clusters(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, cluster) for all events; an event without edges is its own cluster."""
    found = connected_components(edges.selectExpr("src a", "dst b"))
    return events.select("pos").join(found, F.col("pos") == F.col("node"), "left").select("pos", F.coalesce("component", "pos").alias("cluster"))


def linked_clusters(events: DataFrame, linked: DataFrame) -> DataFrame:
    """clusters() of the edges of links(), which are read twice.

    An event's latest predecessor connects all that its earlier ones do, as these are within the time of one another too. Ends of a link are
    near in time, so links dealt by time are contracted where they lie, and only events at the edges of portions connect one portion with another."""
    latest = linked.select("t", F.col("pos").alias("a"), F.get("before", F.lit(0)).alias("b")).where("a <> b")
    dealt = latest.repartitionByRange("t", "a").sortWithinPartitions("t").select("a", "b")
    held = contracted(dealt, centres=True).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"), F.collect_set("b").alias("labels"))
    held = materialize(held, "labels")
    found = connected_components(held.where("size(labels) > 1").select(F.explode("labels").alias("a"), F.col("label").alias("b")))
    placed = join_hot(held.select("node", "label"), found.withColumnRenamed("node", "label"), "label", how="left")
    return events.select("pos").join(placed, F.col("pos") == F.col("node"), "left").select("pos", F.coalesce("component", "label", "pos").alias("cluster"))


def cluster_statistics(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, size, edges, density); an edge counts for the cluster of its later event."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    linked = edges.join(members, F.col("dst") == F.col("pos")).groupBy("cluster").agg(F.count("*").alias("edges"))
    out = sizes.join(linked, "cluster", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return out.withColumn("density", F.round(F.col("edges") / F.col("size"), 6))


def composition(events: DataFrame, members: DataFrame) -> DataFrame:
    """Per event: its cluster's size and the shares of detections, of its type and of its source among them."""
    joined = events.join(members, "pos")
    kinds = joined.groupBy("cluster", "event_type").agg(F.count("*").alias("same"), F.sum(F.col("seed").cast("int")).alias("seeds"), F.max(F.col("seed").cast("int")).alias("has_detection"))
    wholes = kinds.groupBy("cluster").agg(F.sum("same").alias("size"), F.sum("seeds").alias("seeds"), F.max("has_detection").alias("has_detection"))
    kinds = kinds.select(F.col("cluster").alias("c"), F.col("event_type").alias("kind"), "same")
    counted = joined.select("pos", "cluster", "event_type").join(wholes, "cluster").join(kinds, (F.col("cluster") == F.col("c")) & F.col("event_type").eqNullSafe(F.col("kind")))
    share = lambda c: F.round(F.col(c) / F.col("size"), 6).alias
    return counted.select("pos", "cluster", "size", share("seeds")("detection_fraction"), share("same")("event_type_similarity"), "has_detection")


def without_detection(events: DataFrame, members: DataFrame) -> DataFrame:
    """The events of clusters that hold no detection."""
    joined = events.join(members, "pos")
    return joined.join(joined.where("seed").select("cluster").distinct(), "cluster", "left_anti")


def cooccurrence(pairs: DataFrame, group: str, item: str, top: int = TOP_PAIRS) -> DataFrame:
    """The `top` most frequent unordered pairs of items in a group; ties by the items. Nulls are in no group or no item.

    Pairs of groups of SMALL_GROUP items at most are counted first, from lists, in parts of PART_ROWS rows; the least count of their best `top` bounds what can be among the
    best of all. A pair occurs as often as its rarer item at most, so larger groups keep only items that reach the bound. Those that are
    still large are cut into blocks of items and meet by pairs of blocks, counted where they meet, so no task holds a group."""
    held = materialize(pairs.select(F.col(group).alias("g"), F.col(item).alias("x")).where("g is not null and x is not null").distinct(), "pairs")
    sizes = materialize(held.groupBy("g").agg(F.count("*").alias("m")), "sizes")
    often_of = sizes.select("g", F.col("m").alias("n"))
    few = join_hot(held, sizes.where(F.col("m") <= SMALL_GROUP), "g", counts=often_of).select("g", "x")
    # Parts grow in number with the rows, not in size. A part counts its pairs by itself, so a frequent pair is one row a part.
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // PART_ROWS))
    dealt = few.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(16 * parts))).repartition(parts, "part")
    lists = dealt.groupBy("part", "g").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("part", "xs", F.posexplode("xs").alias("i", "a"))
    counted = lists.select("part", "a", F.explode(F.slice("xs", F.col("i") + 2, F.lit(SMALL_GROUP))).alias("b")).groupBy("part", "a", "b").agg(F.count("*").alias("n"))
    counted = counted.repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "counted")
    best = counted.orderBy(F.desc("n")).limit(top).agg(F.when(F.count("*") == top, F.min("n")).otherwise(1).alias("bound"))
    often = held.groupBy("x").agg(F.count("*").alias("often")).join(F.broadcast(best)).where("often >= bound").select("x")  # one row
    large = join_hot(held, sizes.where(F.col("m") > SMALL_GROUP).select("g"), "g", counts=often_of)
    large = materialize(large.join(often, "x", "left_semi"), "large")
    k = large.groupBy("g").agg(F.ceil(F.count("*") / SMALL_GROUP).alias("k"))
    dealt = join_hot(large, k, "g").withColumn("own", F.pmod(F.xxhash64("x"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "x", "own")
    left, right = dealt.withColumnsRenamed({"x": "a", "own": "p"}), dealt.withColumnsRenamed({"x": "b", "own": "q"})
    # In a pair of different blocks an item of one meets those of the other.
    more = left.join(right, ["g", "lo", "hi"]).where("a < b and (lo = hi or p <> q)").groupBy("a", "b").agg(F.count("*").alias("n"))
    return counted.union(more).repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(top)


def cooccurrence_nodes(pairs: DataFrame, edges: DataFrame, group: str, item: str) -> DataFrame:
    """(x, n): in how many groups each item of the edges(a, b) occurs."""
    used = edges.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    return pairs.select(F.col(group).alias("g"), F.col(item).alias("x")).where("g is not null").distinct().join(F.broadcast(used), "x").groupBy("x").agg(F.count("*").alias("n"))  # 2 * TOP_PAIRS items
