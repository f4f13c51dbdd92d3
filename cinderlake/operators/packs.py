"""Context packs, many at once: what stays of each, its text's size, and the trim to a token budget without trying.

A pack's text is made of elements of lists. Items go worst rank first, so every item that may go has a step, and every
element ends at a known step: an entity with the last item that names it, a relationship with the first of its two, a
reference with its item, a list's separators with its elements. What each step frees is then one sum, and the cut is where
the running total fits; nothing is serialized again for an item that goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.operators.context import CONTEXT_ITEMS, ENTITIES, ITEMS, RELATIONSHIPS, item_entities
from cinderlake.plans.stored import materialize

#: Characters of a token, and the longest text that stays whole when nothing else can go.
CHARS_PER_TOKEN, CLIP = 3.5, 80


@dataclass
class Packs:
    """Parts of packs, every one with a column `pack`; json is an element's text, with empty lists of references.

    items(item, id, rank, role, json, entry): entry is the timeline's. entities(place, json) with named(place, item);
    relationships(place, src, dst, json); entries(section, entry, json) with cited(section, entry, item), which stay; rest(chars)."""

    items: DataFrame
    entities: DataFrame
    named: DataFrame
    relationships: DataFrame
    entries: DataFrame
    cited: DataFrame
    rest: DataFrame


def kept(scored: DataFrame, context_items: int = CONTEXT_ITEMS, most: int = ITEMS) -> DataFrame:
    """scored(pack, item, total, first_t, role) rows that stay, with their rank in the pack.

    All detection evidence stays; of the context the best, as many as fit beside it."""
    best = [F.desc("total"), F.asc("first_t"), F.asc("item")]
    context = scored.where("role = 'context'").withColumn("_p", F.row_number().over(Window.partitionBy("pack").orderBy(*best))).where(F.col("_p") <= context_items)
    evidence = scored.where("role <> 'context'")
    taken = evidence.groupBy("pack").agg(F.count("*").alias("_n")).withColumnRenamed("pack", "_pack")
    fitting = context.join(taken, F.col("pack") == F.col("_pack"), "left").where(F.col("_p") <= most - F.coalesce("_n", F.lit(0))).drop("_p", "_n", "_pack")
    return evidence.unionByName(fitting).withColumn("rank", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("total"), "item")))


def entities(found: DataFrame, most: int = ENTITIES) -> tuple[DataFrame, DataFrame]:
    """(entities, named): (pack, place, entity) of most items in each pack, and (pack, place, entity, item, first_t, last_t)."""
    named = found.select("pack", "item", "first_t", "last_t", F.explode(item_entities()).alias("entity"))
    sizes = named.groupBy("pack", "entity").agg(F.count("*").alias("n_items"))
    top = sizes.withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("n_items"), "entity"))).where(F.col("place") <= most)
    top = materialize(top, "entities")
    return top, named.join(top.select("pack", "entity", "place"), ["pack", "entity"])


def relationships(named: DataFrame, most: int = RELATIONSHIPS) -> DataFrame:
    """(pack, place, src, dst, via, delta): items that follow one another on an entity, each pair once; the closest in time."""
    w = Window.partitionBy("pack", "entity").orderBy("first_t", "item")
    follow = named.withColumns({"dst": F.lead("item").over(w), "began": F.lead("first_t").over(w)}).where("dst is not null")
    delta = ((F.col("began") - F.col("last_t")) / 1e6).cast("long")
    once = follow.groupBy("pack", F.col("item").alias("src"), "dst").agg(F.min(F.struct("place", F.col("entity").alias("via"), delta.alias("delta"))).alias("m")).select("pack", "src", "dst", "m.via", "m.delta")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy(F.abs("delta"), "src", "dst"))).where(F.col("place") <= most)


def steps(items: DataFrame) -> DataFrame:
    """items with step: the turn at which a context item goes, the worst first; null for what never goes."""
    going = F.row_number().over(Window.partitionBy("pack", F.col("role") == "context").orderBy(F.desc("rank")))
    return items.withColumn("step", F.when(F.col("role") == "context", going))


def elements(packs: Packs, order: DataFrame) -> DataFrame:
    """(pack, list, element, chars, step): every element of every list and when it goes; null if it doesn't."""
    part = lambda rows, name, element, chars, item, all_=True: rows.select("pack", name.alias("list"), element.cast("string").alias("element"), chars.alias("chars"), item.alias("item"), F.lit(all_).alias("all"))
    c, size = F.col, lambda x: F.length(x).cast("long")
    ids = order.select("pack", "item", (F.length("id") + 2).cast("long").alias("id_chars"))
    inner = lambda rows, *names: rows.join(ids, ["pack", "item"]).select("pack", F.concat_ws(" ", *names).alias("list"), "item", "id_chars")
    ends = F.explode(F.array("src", "dst"))
    reads = part(order, F.lit("evidence"), c("item"), size("json"), c("item"))
    for rows in (
        part(order, F.lit("timeline"), c("item"), size("entry"), c("item")),
        part(packs.named.join(packs.entities.select("pack", "place", "json"), ["pack", "place"]), F.lit("entities"), c("place"), size("json"), c("item"), False),
        part(inner(packs.named, F.lit("entity"), "place"), c("list"), c("item"), c("id_chars"), c("item")),
        part(packs.relationships.select("pack", "place", "json", ends.alias("item")), F.lit("relationships"), c("place"), size("json"), c("item")),
        part(packs.entries, c("section"), c("entry"), size("json"), F.lit(None).cast("long")),
        part(inner(packs.cited, "section", "entry"), c("list"), c("item"), c("id_chars"), c("item")),
    ):
        reads = reads.union(rows)
    met = reads.join(order.select("pack", "item", "step"), ["pack", "item"], "left")
    last = F.when(F.count_if(F.col("step").isNull()) == 0, F.max("step"))
    return met.groupBy("pack", "list", "element", "all").agg(F.max("chars").alias("chars"), F.when(F.col("all"), F.min("step")).otherwise(last).alias("step")).drop("all")


def sums(packs: Packs, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What trim() reads of elements(), whatever the budget: (pack, step, freed) and, from the tail, (pack, popped, freed, n) of relationships that no step takes."""
    # Separators: one an element but the last of a list, so a list that empties gives one back.
    gone = F.when(F.count_if(F.col("step").isNull()) == 0, F.max("step"))
    lists = found.groupBy("pack", "list").agg(gone.alias("step")).select("pack", F.lit(-1).cast("long").alias("chars"), "step")
    sized = found.select("pack", (F.col("chars") + 1).alias("chars"), "step").union(lists).union(packs.rest.select("pack", "chars", F.lit(None).cast("int")))
    by_step = materialize(sized.groupBy("pack", "step").agg(F.sum("chars").alias("freed")), "freed")
    tail = found.where("list = 'relationships' and step is null").select("pack", F.col("element").cast("int").alias("place"), (F.col("chars") + 1).alias("chars"))
    back = Window.partitionBy("pack").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    tail = tail.withColumns({"popped": F.count("*").over(back), "freed": F.sum("chars").over(back), "n": F.count("*").over(Window.partitionBy("pack"))})
    tail = tail.withColumn("freed", F.col("freed") - F.when(F.col("popped") == F.col("n"), 1).otherwise(0)).select("pack", "popped", "freed", "n")
    return by_step, materialize(tail, "tail")


def trim(packs: Packs, most_tokens: Column, found: DataFrame | None = None, summed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(pack, chars, tokens, cut, popped, clipped): the size of each pack's text after the trim, how many context items and then
    relationships go, and whether texts are clipped, as nothing else can go. most_tokens may depend on `pack`; summed is sums(), if several budgets share it.

    Items of equal rank don't occur. tokens are those before texts are clipped. A pack's running total is over its context items
    and its relationships, of which there are CONTEXT_ITEMS and RELATIONSHIPS at most."""
    if summed is None:
        summed = sums(packs, materialize(elements(packs, steps(packs.items)), "elements") if found is None else found)
    by_step, tail = summed
    whole = by_step.groupBy("pack").agg(F.sum("freed").alias("chars"), F.coalesce(F.max("step"), F.lit(0)).alias("context"))
    limit = F.floor(most_tokens * CHARS_PER_TOKEN)
    run = by_step.where("step is not null").union(whole.select("pack", F.lit(0), F.lit(0).cast("long"))).join(whole, "pack")
    left = F.col("chars") - F.sum("freed").over(Window.partitionBy("pack").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    cut = run.withColumn("left", left).withColumn("fits", F.col("left") <= limit)
    cut = cut.where(F.col("fits") | (F.col("step") == F.col("context"))).groupBy("pack").agg(F.min_by(F.struct("step", "left", "fits"), "step").alias("c")).select("pack", F.col("c.step").alias("cut"), F.col("c.left").alias("chars"), "c.fits")
    # Then relationships go from the tail.
    over = cut.where(~F.col("fits")).join(tail, "pack", "left").withColumn("left", F.col("chars") - F.coalesce("freed", F.lit(0))).withColumn("fits", F.col("left") <= limit)
    over = over.where(F.col("fits") | F.col("n").isNull() | (F.col("popped") == F.col("n"))).groupBy("pack", "cut").agg(F.min_by(F.struct("left", "popped", "fits"), "popped").alias("c"), F.max(F.when(F.col("n").isNull(), F.col("left"))).alias("none"))
    over = over.select("pack", "cut", F.coalesce("c.left", "none").alias("chars"), F.coalesce("c.popped", F.lit(0)).alias("popped"), (~F.coalesce("c.fits", F.lit(False))).alias("clipped"))
    done = cut.where("fits").select("pack", "cut", "chars", F.lit(0).cast("long").alias("popped"), F.lit(False).alias("clipped")).union(over.select("pack", "cut", "chars", "popped", "clipped"))
    return done.select("pack", "chars", F.ceil(F.col("chars") / CHARS_PER_TOKEN).alias("tokens"), "cut", "popped", "clipped")


def trimmed(packs: Packs, most_tokens: Column, found: DataFrame | None = None) -> tuple[Packs, DataFrame]:
    """The parts of packs that stay under a budget, and what trim() says; nothing in them names an item that is gone.

    found is elements(), if several budgets share it."""
    cuts = materialize(trim(packs, most_tokens, found), "cuts")
    alive = materialize(steps(packs.items).join(cuts.select("pack", "cut"), "pack").where("step is null or step > cut").drop("cut", "step"), "alive")
    ids = alive.select("pack", "item")
    named = packs.named.join(ids, ["pack", "item"], "left_semi")
    pairs = packs.relationships.join(ids.withColumnRenamed("item", "src"), ["pack", "src"], "left_semi").join(ids.withColumnRenamed("item", "dst"), ["pack", "dst"], "left_semi")
    from_tail = F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("place")))
    pairs = pairs.withColumn("_tail", from_tail).join(cuts.select("pack", "popped"), "pack").where("_tail > popped").select(packs.relationships.columns)
    return Packs(alive, packs.entities.join(named.select("pack", "place").distinct(), ["pack", "place"], "left_semi"), named, pairs, packs.entries, packs.cited.join(ids, ["pack", "item"], "left_semi"), packs.rest), cuts


def clipped(texts: Column) -> Column:
    """A map of texts when nothing else can go: the long ones clipped and alone; as it was if there are none."""
    long = F.map_filter(texts, lambda _, v: F.length(v) > CLIP)
    return F.when(F.size(long) > 0, F.transform_values(long, lambda _, v: F.concat(F.substring(v, 1, CLIP), F.lit("…")))).otherwise(texts)
