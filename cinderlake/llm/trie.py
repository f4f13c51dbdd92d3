"""Prefix trie of rebuilt conversations by family-first merging.

Conversations are dealt by family (the base id c - c % 20), rebuilt beside their base's first turns, and each family's
own small trie is made where its rows lie: nodes with a bit for every member. Only these combined nodes are shuffled, to
be merged by the digest of their turns. What the merging finds (members, the smallest of them, the longest) goes back
to the families, whose members then add up their paths from the end.

A node belongs to its smallest member, and a conversation owns the end of its path: the sum over a subtree is the sum over
the members of what each of them owns from that depth on. So subtrees need no walk from level to level, however deep.

A node is named by its depth and 128 bits: the exclusive or, over its turns, of two 64-bit hashes of depth and of the MD5
of role and text. These run along a conversation in pieces, so a conversation may be spread over many tasks. A node's
members come from partial aggregates, the root's too. Only a node's sorted list of ended members is one stream, as
one SHA-256 asks for it: a row for up to 1000 families, in bounded memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.llm.common import WORD, col, join_hot, materialize
from cinderlake.llm.turns import in_order

#: Conversations whose ids share id - id % FAMILY are a family; a member takes over at most HEADS - 1 turns of its base.
FAMILY, HEADS = 20, 4
#: Families whose ended members make one row of a node's list.
BLOCK_FAMILIES = 1000
NODE = ["depth", "k1", "k2"]
UP, DOWN = Window.unboundedPreceding, Window.unboundedFollowing


def turn_digest(role: Column, text: Column) -> Column:
    """MD5 of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(c, base, _part, _apart, length, depth, turn, n_words): the rebuilt turns of every conversation and its root.

    Rows go by turn (null first), then by role and MD5 of role and text. Null role or text counts as empty; rows without
    conv_id belong to no conversation and are left out. A base that is absent or short hands over what it has."""
    role, text = F.coalesce(col("role"), F.lit("")), F.coalesce(col("text"), F.lit(""))
    c = col("conv_id").cast("long")
    slim = conversations.where(c.isNotNull()).select(c.alias("c"), col("turn").alias("number"), role.alias("role"), turn_digest(role, text).alias("turn"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    rows = in_order(slim, "c", [F.col("number").asc_nulls_first(), F.col("role"), F.col("turn")])
    rows = rows.select("c", (F.col("c") - F.col("c") % FAMILY).alias("base"), "_part", "_apart", "_at", "_rows", "turn", "n_words")
    first = F.struct("_at", "turn", "n_words")
    heads = rows.where((F.col("c") == F.col("base")) & (F.col("_at") < HEADS - 1)).groupBy("base").agg(F.array_sort(F.collect_list(first)).alias("heads"))
    h = (F.crc32(F.col("c").cast("string")) % HEADS).cast("int")
    met = join_hot(rows, heads, "base", how="left").withColumn("h", h).withColumn("taken", F.least("h", F.coalesce(F.size("heads"), F.lit(0))))
    node = lambda depth, turn, n: F.struct(depth.cast("long").alias("depth"), turn.alias("turn"), n.alias("n_words"))
    none = F.array().cast("array<struct<depth:long,turn:binary,n_words:long>>")
    top = F.array(node(F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("long")))
    taken = F.transform(F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("taken")), lambda x: node(x["_at"] + 1, x["turn"], x["n_words"]))
    own = F.array(node(F.col("taken") + F.col("_at") - F.col("h") + 1, F.col("turn"), F.col("n_words")))
    nodes = F.concat(F.when(F.col("_at") == 0, F.concat(top, taken)).otherwise(none), F.when(F.col("_at") >= F.col("h"), own).otherwise(none))
    length = F.col("taken") + F.greatest(F.col("_rows") - F.col("h"), F.lit(0))
    return met.select("c", "base", "_part", "_apart", length.alias("length"), F.explode(nodes).alias("_node")).select("c", "base", "_part", "_apart", "length", "_node.*")


def carried(pieces: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the columns that `pieces` (c, _part, ...) has for the pieces of spread conversations; at most two a boundary."""
    named = pieces.withColumnsRenamed({"c": "_c", "_part": "_p"})
    return rows.join(F.broadcast(named), (F.col("c") == F.col("_c")) & (F.col("_part") == F.col("_p")), "left").drop("_c", "_p")


def family_tries(turns: DataFrame) -> DataFrame:
    """(_part, base, depth, k1, k2, p1, p2, n_words, longest, members, ends): nodes of each family's trie, written.

    members and ends have a bit for each conversation of the family that passes or ends there; p1 and p2 name the parent."""
    hashes = {"g1": F.xxhash64("depth", "turn"), "g2": F.xxhash64(F.lit(1), "depth", "turn")}
    step = turns.select("*", *[F.when(F.col("depth") > 0, g).otherwise(F.lit(0).cast("long")).alias(n) for n, g in hashes.items()])
    pieces = step.where("_apart").groupBy("c", "_part").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"))
    before = Window.partitionBy("c").orderBy("_part").rowsBetween(UP, -1)
    pieces = pieces.select("c", "_part", F.bit_xor("g1").over(before).alias("b1"), F.bit_xor("g2").over(before).alias("b2"))
    # Dealt by family: the windows over a conversation and the aggregate over a family need no further exchange.
    path = Window.partitionBy("_part", "base", "c").orderBy("depth").rowsBetween(UP, 0)
    met = carried(pieces, step).repartition("_part", "base")
    for i in ("1", "2"):
        met = met.withColumn("k" + i, F.bit_xor("g" + i).over(path).bitwiseXOR(F.coalesce("b" + i, F.lit(0).cast("long"))))
        met = met.withColumn("p" + i, F.col("k" + i).bitwiseXOR(F.col("g" + i)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("c") - F.col("base") + FAMILY - 1).cast("int"))
    ended = F.when(F.col("length") == F.col("depth"), bit).otherwise(F.lit(0).cast("long"))
    one = lambda n: F.max(n).alias(n)
    found = met.groupBy("_part", "base", *NODE).agg(one("p1"), one("p2"), one("n_words"), F.max("length").alias("longest"), F.min("c").alias("least"), F.bit_or(bit).alias("members"), F.bit_or(ended).alias("ends"), one("_apart"))
    return materialize(found, "family-tries")


def members_of(mask: Column, base: Column) -> Column:
    """Ids of the conversations whose bits are set, ascending."""
    set_ = F.filter(F.sequence(F.lit(0), F.lit(2 * FAMILY - 2)), lambda i: F.call_function("getbit", mask, i) == 1)
    return F.transform(set_, lambda i: base + i - (FAMILY - 1))


def ends_digests(tries: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end, by streaming each node's sorted list."""
    block = F.floor(F.col("base") / (FAMILY * BLOCK_FAMILIES)).alias("block")
    blocks = tries.where("ends <> 0").groupBy(*NODE, block).agg(F.array_sort(F.flatten(F.collect_list(members_of(F.col("ends"), F.col("base"))))).alias("ids"))
    lists = blocks.select(*NODE, "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches):
        now, running = None, None
        for batch in batches:
            done = []
            for depth, k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (depth, k1, k2) != now:
                    if now is not None:
                        done.append((*now, running.hexdigest()))
                    now, running = (depth, k1, k2), hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield out(done)
        if now is not None:
            yield out([(*now, running.hexdigest())])

    def out(rows):
        depth, k1, k2, digests = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (depth, k1, k2)] + [pa.array(digests, pa.string())], names=[*NODE, "ends_sha256"])

    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    conv_id, the smallest member; depth; node_id (hex); n_words of its last turn (root: 0); parent_conv_id, the parent's
    smallest member (root: null); n_convs, its members; n_children; n_leaves, childless nodes of its subtree, itself
    included; saved_tokens, the sum over its subtree of (n_convs - 1) * n_words; n_ends, members that end there;
    ends_sha256 of their ids, ascending and comma-joined.
    A conversation is rebuilt from the first crc32(id) % 4 turns of its base and its own turns after as many. Turns are equal
    if role and text are. Ids below 0 belong to the base that % gives them in SQL (-5 to base 0). Repeated rows are turns
    of their own. An empty table has no node, not even a root. Other columns are ignored."""
    tries = family_tries(rebuilt(conversations))
    count = lambda mask: F.bit_count(mask).cast("long")
    one = lambda n: F.max(n).alias(n)
    merged = tries.groupBy(*NODE).agg(one("p1"), one("p2"), one("n_words"), one("longest"), F.min("least").alias("conv_id"), F.sum(count(F.col("members"))).alias("n_convs"), F.sum(count(F.col("ends"))).alias("n_ends"), F.count("*").alias("families"))
    merged = materialize(merged, "nodes")
    told = join_hot(tries.select("_part", "base", *NODE, "members", "_apart"), merged.drop("p1", "p2"), *NODE, counts=merged.select(*NODE, F.col("families").alias("n")))
    paths = told.withColumn("c", F.explode(members_of(F.col("members"), F.col("base")))).drop("members")
    own = lambda value: F.when(F.col("c") == F.col("conv_id"), value).otherwise(F.lit(0).cast("long"))
    paths = paths.withColumn("leaf", own((F.col("depth") == F.col("longest")).cast("long"))).withColumn("saved", own((F.col("n_convs") - 1) * F.col("n_words")))
    after = Window.partitionBy("c").orderBy("_part").rowsBetween(1, DOWN)
    pieces = paths.where("_apart").groupBy("c", "_part").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.max_by("conv_id", "depth").alias("last"))
    pieces = pieces.select("c", "_part", F.sum("leaf").over(after).alias("leaf_after"), F.sum("saved").over(after).alias("saved_after"), F.lag("last").over(Window.partitionBy("c").orderBy("_part")).alias("last_before"))
    met = carried(pieces, paths).repartition("_part", "base")
    path = Window.partitionBy("_part", "base", "c").orderBy(F.desc("depth"))
    rest = path.rowsBetween(UP, 0)
    total = lambda n: (F.sum(n).over(rest) + F.coalesce(n + "_after", F.lit(0))).alias(n)
    summed = met.select(*NODE, "conv_id", "n_convs", "n_ends", "n_words", F.coalesce(F.lead("conv_id").over(path), "last_before").alias("parent_conv_id"), total("leaf"), total("saved"))
    nothing = lambda n: F.lit(None).cast("long").alias(n)
    child = merged.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), *map(nothing, ("conv_id", "n_convs", "n_ends", "n_words", "parent_conv_id", "leaf", "saved")), F.lit(1).cast("long").alias("child"))
    both = summed.withColumn("child", F.lit(0).cast("long")).unionByName(child)
    nodes = both.groupBy(*NODE).agg(*map(one, ("conv_id", "n_convs", "n_ends", "n_words", "parent_conv_id")), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    nodes = nodes.join(ends_digests(tries), NODE, "left")
    node_id = F.lower(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
    return nodes.select("conv_id", "depth", node_id.alias("node_id"), "n_words", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
