"""Reversible line dedup: sharded cuckoo filters before exact reference counts.

A line's key is the line without blanks at both ends, A-Z lower-cased, if it has at least MIN_CHARS code points. Keys are dealt to
shards by hash. A shard has cuckoo filters with a fingerprint of every live key, and the exact tables behind them: the
references (key, document, text, lines) and for each key their number with the first and last document. A batch of documents asks the filters
first: what they haven't seen is new for certain and goes straight into the counts; only keys that they may hold are
looked up and counted again among the references. Documents leave the same way, by references of negative lines; a key
without documents leaves its filter. All tables are written as deltas, so a lost executor or a failed batch leaves the
store as it was.

Keys are MD5 digests (128 bits). Tasks hold one shard's filters and one Arrow batch at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import col, join_hot, materialize

MIN_CHARS = 10
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Slots of a bucket, buckets of a shard's first filter, its fullest load, and rounds of eviction before a further filter.
SLOTS, FIRST_BUCKETS, LOAD, ROUNDS = 4, 1 << 10, 0.9, 200
#: Keys of a shard if a store comes to hold twice the references of its first batch.
SHARD_KEYS = 1 << 17
#: What the filters are told of a key: to add it unless it may be held already, to add it, or to take it out.
ASK, ADD, TAKE = 0, 1, 2
KEY, DOC = ["shard", "key"], ["no_id", "doc"]


class Cuckoo:
    """Cuckoo filters of one shard: 16-bit fingerprints in two possible buckets each; a full filter gets a larger one beside it."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @staticmethod
    def load(blob: bytes) -> Cuckoo:
        tables, at = [], 0
        while at < len(blob):
            n = int.from_bytes(blob[at : at + 8], "little")
            tables.append(np.frombuffer(blob, np.uint16, n * SLOTS, at + 8).reshape(n, SLOTS).copy())
            at += 8 + 2 * n * SLOTS
        return Cuckoo(tables)

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def prints(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, fingerprint) of keys given as rows of two unsigned 64-bit numbers."""
        low = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        return keys[:, 0], np.where(low == 0, np.uint16(1), low)

    @staticmethod
    def other(bucket: np.ndarray, prints: np.ndarray, mask: int) -> np.ndarray:
        """The other bucket of a fingerprint; the other of the other is the first."""
        return (bucket ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7))) & np.uint64(mask)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be held; false is certain."""
        hashes, prints = self.prints(keys)
        found = np.zeros(len(keys), bool)
        for t in self.tables:
            mask = len(t) - 1
            a = hashes & np.uint64(mask)
            for b in (a, self.other(a, prints, mask)):
                found |= (t[b.astype(np.int64)] == prints[:, None]).any(1)
        return found

    def add(self, keys: np.ndarray) -> None:
        """Insert keys, one fingerprint each; equal fingerprints are kept apart, so each can be taken out again."""
        if not len(keys):
            return
        hashes, prints = self.prints(keys)
        if not self.tables:  # a power of two buckets, as in all tables
            self.tables.append(np.zeros((FIRST_BUCKETS, SLOTS), np.uint16))
        t = self.tables[-1]
        room = int((t == 0).sum()) - int((1 - LOAD) * t.size)
        first = max(0, min(room, len(keys)))
        left = self.place(t, hashes[:first] & np.uint64(len(t) - 1), prints[:first])
        rest = np.concatenate([left, np.arange(first, len(keys))])
        if len(rest):
            n = 2 * len(t) if first < len(keys) else FIRST_BUCKETS
            while n * SLOTS * LOAD < len(rest):
                n *= 2
            self.tables.append(np.zeros((n, SLOTS), np.uint16))
            self.add(keys[rest])

    def place(self, t: np.ndarray, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put fingerprints into a table, round by round; numbers of those that find no place are returned.

        What an eviction displaces goes on in its place. If that doesn't end, all is undone and each half tried by itself."""
        saved, mask = t.copy(), len(t) - 1
        moving, at = prints.copy(), bucket.copy()
        tried = np.zeros(len(prints), bool)
        for turn in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            b = at[order].astype(np.int64)
            rank = np.arange(len(b)) - np.searchsorted(b, b)
            free = t[b] == 0
            fits = rank < free.sum(1)
            slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            t[b[fits], slot] = moving[order[fits]]
            stay = order[~fits]
            moving, at, tried = moving[stay], at[stay], tried[stay]
            if not len(moving):
                return stay
            # Those that tried one bucket try the other; then one a bucket evicts an entry, which moves on.
            fresh = ~tried
            at[fresh] = self.other(at[fresh], moving[fresh], mask)
            tried[fresh] = True
            old = np.flatnonzero(~fresh)
            old = old[np.unique(at[old], return_index=True)[1]]
            where, which = at[old].astype(np.int64), (old + turn) % SLOTS
            moving[old], t[where, which] = t[where, which], moving[old].copy()
            at[old] = self.other(at[old], moving[old], mask)
        t[:] = saved
        if len(prints) == 1:
            return np.zeros(1, np.int64)
        half = len(prints) // 2
        return np.concatenate([self.place(t, bucket[:half], prints[:half]), half + self.place(t, bucket[half:], prints[half:])])

    def remove(self, keys: np.ndarray) -> None:
        """Take out one fingerprint of each key; the keys must be held."""
        hashes, prints = self.prints(keys)
        for h, p in zip(hashes, prints):
            for t in self.tables:
                mask = len(t) - 1
                a = h & np.uint64(mask)
                at = next(((int(b), s) for b in (a, self.other(a, p, mask)) for s in range(SLOTS) if t[int(b), s] == p), None)
                if at is not None:
                    t[at] = 0
                    break


def as_numbers(keys: pa.Array) -> np.ndarray:
    """16-byte keys as rows of two unsigned 64-bit numbers."""
    _, offsets, values = keys.buffers()
    first = np.frombuffer(offsets, np.int32)[keys.offset] if len(keys) else 0
    return np.frombuffer(values or b"", np.uint64, 2 * len(keys), int(first)).reshape(-1, 2)


def named(docs: DataFrame) -> DataFrame:
    """docs with no_id, doc and text_id. Rows with one doc_id are one document; those without are one, after all others."""
    doc, text = col("doc_id"), F.coalesce(col("text"), F.lit(""))
    return docs.select(doc.isNull().alias("no_id"), F.coalesce(doc.cast("long"), F.lit(0).cast("long")).alias("doc"), F.unhex(F.md5(text)).alias("text_id"), text.alias("_text"), F.struct("*").alias("row"))


def line_keys(text: str) -> list[bytes | None]:
    """The key of each line of a text whose A-Z are lower-cased already; none for short lines."""
    return [hashlib.md5(k.encode()).digest() if len(k := line.strip(BLANK_CHARS)) >= MIN_CHARS else None for line in text.split("\n")]


def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (no_id, doc, text_id, _text) as (no_id, doc, text_id, key, lines), a key of a text once."""
    for batch in batches:
        at, keys, lines = [], [], []
        for i, text in enumerate(pc.ascii_lower(batch.column(3)).to_pylist()):
            found = Counter(line_keys(text))
            found.pop(None, None)
            at += [i] * len(found)
            keys += found.keys()
            lines += found.values()
        whose = batch.select([0, 1, 2]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*whose.columns, pa.array(keys, pa.binary()), pa.array(lines, pa.int64())], names=[*DOC, "text_id", "key", "lines"])


def references(docs: DataFrame) -> DataFrame:
    """(key, no_id, doc, text_id, lines): the keys of each document's texts, and how many lines have them."""
    lines = named(docs).select(*DOC, "text_id", "_text").mapInArrow(listed, "no_id boolean, doc long, text_id binary, key binary, lines long")
    return lines.groupBy("key", *DOC, "text_id").agg(F.sum("lines").alias("lines"))


def counted(refs: DataFrame) -> DataFrame:
    """(shard, key, refs, first, last, no_id): number of references, first and last doc_id, whether any has none, by key."""
    doc = F.when(~F.col("no_id"), F.col("doc"))
    return refs.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min(doc).alias("first"), F.max(doc).alias("last"), F.max(F.col("no_id").cast("int")).alias("no_id"))


def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, act, key, blob) by shard, its filters (blob) first, as (shard, key, blob): keys that may have been held
    before this pass, and the filters after it."""
    now, before, after = None, Cuckoo(), Cuckoo()

    def out(keys: list, blob: bytes | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now] * len(keys), pa.int64()), pa.array(keys, pa.binary()), pa.array([blob] * len(keys), pa.binary())], names=["shard", "key", "blob"])

    for batch in batches:
        shard, act = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (np.diff(act, prepend=-2) != 0))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
            if shard[lo] != now:
                if now is not None:
                    yield out([None], after.dump())
                now, before, after = int(shard[lo]), Cuckoo(), Cuckoo()
            if act[lo] < ASK:
                blob = batch.column(3)[lo].as_py()
                before, after = Cuckoo.load(blob), Cuckoo.load(blob)
                continue
            keys = batch.column(2).slice(lo, hi - lo)
            numbers = as_numbers(keys)
            if act[lo] == TAKE:
                after.remove(numbers)
            elif act[lo] == ADD:
                after.add(numbers)
            else:
                held = before.holds(numbers)
                after.add(numbers[~held])
                if held.any():
                    yield out(keys.filter(pa.array(held)).to_pylist())
    if now is not None:
        yield out([None], after.dump())


class LineStore:
    """The lines of all documents that were inserted and not deleted since.

    The number of shards is given, or comes from the first batch; a shard's memory grows with the store from then on."""

    def __init__(self, shards: int | None = None):
        self.shards = shards
        self.refs: DataFrame | None = None
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.batches = 0

    def live(self, keys: DataFrame) -> DataFrame:
        """References in the store of some keys."""
        refs = self.refs.join(keys, KEY, "left_semi")
        return refs.groupBy(*KEY, *DOC, "text_id").agg(F.sum("lines").alias("lines")).where("lines > 0")

    def tell(self, keys: DataFrame, act: int) -> DataFrame:
        """Tell the filters of keys; those that they may have held before, if asked."""
        none = F.lit(None).cast("binary")
        rows = keys.select("shard", F.lit(act).alias("act"), "key", none.alias("blob"))
        if self.filters is not None:
            rows = rows.unionByName(self.filters.select("shard", F.lit(-1).alias("act"), none.alias("key"), "blob"))
        done = materialize(rows.repartition("shard").sortWithinPartitions("shard", "act").mapInArrow(told, "shard long, key binary, blob binary"), "filters")
        self.filters = done.where("key is null").select("shard", "blob")
        return done.where("key is not null").select(*KEY)

    def add(self, delta: DataFrame) -> None:
        self.batches += 1
        self.refs = delta if self.refs is None else self.refs.unionByName(delta)

    def count(self, counts: DataFrame, instead_of: DataFrame | None = None) -> None:
        """Add counts; those of some keys are replaced."""
        written = materialize(counts, "counts")
        if self.counts is not None:
            written = self.counts.join(instead_of, KEY, "left_anti").unionByName(written)
        self.counts = written

    def insert(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text; other columns are ignored). A document that is there already gets the lines as well."""
        delta = materialize(references(docs), "refs")
        self.shards = self.shards or 1 + 2 * delta.count() // SHARD_KEYS
        delta = delta.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)))
        new = counted(delta)
        maybe = self.tell(new, ASK)
        self.add(delta)
        if self.counts is None:
            return self.count(new)
        # Keys that the filters took for others are added for their own, so that either can leave without the other.
        self.tell(maybe.join(self.counts, KEY, "left_anti"), ADD)
        self.count(new.join(maybe, KEY, "left_anti").unionByName(counted(self.live(maybe))), maybe)

    def delete(self, ids: DataFrame) -> None:
        """Take documents (doc_id; null for those without) out again, as if they had never been inserted; unknown ids are ignored."""
        if self.refs is None:
            return
        gone = ids.select(col("doc_id").isNull().alias("no_id"), F.coalesce(col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc")).distinct()
        left = self.refs.join(gone, DOC, "left_semi").groupBy(*KEY, *DOC, "text_id").agg((-F.sum("lines")).alias("lines")).where("lines < 0")
        delta = materialize(left, "refs")
        touched = delta.select(*KEY).distinct()
        self.add(delta)
        rest = materialize(counted(self.live(touched)), "rest")
        self.tell(touched.join(rest, KEY, "left_anti"), TAKE)
        self.count(rest, touched)

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """(row, n_lines, n_dropped, kept): every row of docs with its text without lines that an earlier document holds.

        A key that two documents of the store hold keeps its lines in the first of them (least doc_id). Other lines, those
        without a key too, stay. row has all columns of docs; a null text counts as one empty line."""
        rows = named(docs)
        if self.refs is None:
            return rows.select("row", count_lines(F.col("_text")).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("_text").alias("kept"))
        shared = self.counts.where("first <> last or (no_id = 1 and first is not null)")
        held = join_hot(self.refs.drop("shard"), shared.select("key", "first"), "key", counts=shared.select("key", F.col("refs").alias("n")))
        later = held.where("no_id or doc <> first").repartition(*DOC, "text_id").groupBy(*DOC, "text_id", "key").agg(F.sum("lines").alias("lines"))
        drops = later.where("lines > 0").groupBy(*DOC, "text_id").agg(F.collect_list("key").alias("drops"))
        met = join_hot(rows, drops, *DOC, "text_id", how="left")
        cut = F.pandas_udf(without, "n long, text string")(F.when(F.col("drops").isNotNull(), F.col("_text")), F.col("drops"))
        met = met.withColumn("_cut", cut)
        return met.select("row", count_lines(F.col("_text")).alias("n_lines"), F.coalesce("_cut.n", F.lit(0).cast("long")).alias("n_dropped"), F.coalesce("_cut.text", "_text").alias("kept"))


def count_lines(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def without(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    """Texts without the lines whose keys are given; nothing where no keys are."""
    counts: list[int | None] = []
    kept: list[str | None] = []
    for t, low, d in zip(text, pc.ascii_lower(pa.array(text, pa.string(), from_pandas=True)).to_pylist(), drops):
        if d is None:
            counts.append(None)
            kept.append(None)
            continue
        bad, lines = set(map(bytes, d)), t.split("\n")
        stay = [line for line, key in zip(lines, line_keys(low)) if key not in bad]
        counts.append(len(lines) - len(stay))
        kept.append("\n".join(stay))
    return pd.DataFrame({"n": pd.array(counts, "Int64"), "text": kept})
