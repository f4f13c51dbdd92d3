"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders ORDER to 0 with escape probabilities (method C: in a context seen n
times with d distinct successors, a successor seen c times costs -log2(c/(n+d)) bits, an escape -log2(d/(n+d)) and the
next shorter context; below order 0 every byte costs 8 bits). Statistics are frozen after training, so the code
length of a byte depends on its ORDER+1 bytes alone: one table, shared by all languages, holds it for every context
that training saw, and a text's code length is the sum over its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.llm.common import col, id_crc_mod

ORDER = 3
#: Training takes, for each language, whole texts in the order of a hash until this many bytes are reached: a bound on
#: what is learned, whatever the corpus holds.
TRAIN_BYTES = 1_500_000
PIECE = 1 << 20


def grams(text: bytes, order: int = ORDER) -> np.ndarray:
    """The order+1 bytes that end at each byte, as integers; zero bytes stand before the text."""
    b = np.frombuffer(b"\0" * order + text, dtype=np.uint8).astype(np.uint64)
    n = len(text)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | b[k : k + n]
    return out


def count_grams(batches):
    """(lang, gram, n) of each Arrow batch of (lang, text)."""
    for batch in batches:
        for lang in set(batch.column(0).to_pylist()):
            rows = [t.encode() for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if g == lang]
            found, n = np.unique(np.concatenate([grams(t) for t in rows]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """Frozen statistics of all languages; cost(text) gives the bits of a text under each."""

    def __init__(self, rows: list[tuple[str, int, int]], order: int = ORDER):
        self.order, self.langs = order, sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        lang = np.array([at[r[0]] for r in rows], dtype=np.int64)
        gram = np.array([r[1] for r in rows], dtype=np.int64)
        count = np.array([r[2] for r in rows], dtype=np.float64)
        size = len(self.langs)
        #: tables[k]: known contexts of k bytes with a successor (sorted), and their bits by language.
        self.tables, self.escape = [], []
        below_keys, below_bits = None, None
        for k in range(order + 1):
            key = gram & ((1 << 8 * (k + 1)) - 1)
            keys, index = np.unique(key, return_inverse=True)
            c = np.zeros((len(keys), size))
            np.add.at(c, (index, lang), count)
            ctx, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
            np.add.at(total, of, c)
            np.add.at(kinds, of, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(c / (total[of] + kinds[of]))
            if k == 0:
                lower = np.full((len(keys), size), 8.0)
            else:
                lower = below_bits[np.searchsorted(below_keys, keys & ((1 << 8 * k) - 1))]
            bits = np.where(c > 0, seen, escape[of] + lower)
            self.tables.append((keys.astype(np.uint64), bits.astype(np.float32)))
            self.escape.append((ctx.astype(np.uint64), escape.astype(np.float32)))
            below_keys, below_bits = keys, bits
        self._slots()

    def _slots(self) -> None:
        """An open hash of the longest contexts, for one look-up a byte."""
        keys = self.tables[-1][0]
        self.bits = max(10, int(len(keys) * 8).bit_length())
        self.slot_key = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.slot_row = np.zeros(1 << self.bits, dtype=np.int32)
        left = np.arange(len(keys))
        for step in range(1 << self.bits):
            if not len(left):
                break
            place = self._place(keys[left], step)
            free = self.slot_key[place] == np.iinfo(np.uint64).max
            first = np.unique(np.where(free, place, -1), return_index=True)
            take = first[1][first[0] >= 0]
            self.slot_key[place[take]], self.slot_row[place[take]] = keys[left[take]], left[take]
            left = np.delete(left, take)
            self.probes = step + 1

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def _rows(self, gram: np.ndarray) -> np.ndarray:
        """Row of each gram in the longest table, or -1."""
        place = self._place(gram, 0)
        out = np.where(self.slot_key[place] == gram, self.slot_row[place], -1)
        open_ = np.flatnonzero((out < 0) & (self.slot_key[place] != np.iinfo(np.uint64).max))
        for step in range(1, self.probes):
            if not len(open_):
                break
            place = self._place(gram[open_], step)
            hit = self.slot_key[place] == gram[open_]
            out[open_[hit]] = self.slot_row[place[hit]]
            open_ = open_[~hit & (self.slot_key[place] != np.iinfo(np.uint64).max)]
        return out

    def _unknown(self, gram: np.ndarray) -> np.ndarray:
        """Bits of grams that the longest table lacks, by way of shorter contexts."""
        bits = np.zeros((len(gram), len(self.langs)))
        left = np.arange(len(gram))
        for k in range(self.order, -1, -1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            key = gram[left] & mask
            keys, known = self.tables[k]
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[i] == key
            bits[left[hit]] += known[i[hit]]
            left, key = left[~hit], key[~hit]
            ctx, escape = self.escape[k]
            i = np.minimum(np.searchsorted(ctx, key >> np.uint64(8)), len(ctx) - 1)
            hit = ctx[i] == key >> np.uint64(8)
            bits[left[hit]] += escape[i[hit]]
        bits[left] += 8.0
        return bits

    def cost(self, text: bytes) -> np.ndarray:
        total = np.zeros(len(self.langs))
        for start in range(0, len(text), PIECE):
            lead = min(start, self.order)
            gram = grams(text[start - lead : start + PIECE], self.order)[lead:]
            row = self._rows(gram)
            known = row >= 0
            total += self.tables[-1][1][row[known]].sum(axis=0, dtype=np.float64)
            if not known.all():
                total += self._unknown(gram[~known]).sum(axis=0)
        return total

    def predict(self, text: bytes) -> tuple[str, float]:
        """The language of least code length and its posterior under equal priors; ties go to the first name."""
        cost = self.cost(text)
        best = int(np.argmin(cost))
        return self.langs[best], float(1 / np.exp2(np.maximum(cost[best] - cost, -1000.0)).sum())


def train(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from labelled(doc_id, text, lang); rows with null text or lang teach nothing."""
    size = F.octet_length("text")
    order = Window.partitionBy("lang").orderBy("hash", "doc_id", "text")
    ranked = labelled.where("text is not null and lang is not null and text <> ''").select("lang", "text", "doc_id", F.xxhash64(F.lit(7), "doc_id", F.crc32("text")).alias("hash"), size.alias("size"))
    # A first cut by a hash threshold keeps what one language brings to a task small; the window then takes the bound.
    totals = ranked.groupBy("lang").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    share = (4.0 * train_bytes + 8 * F.col("largest")) / F.col("bytes")
    thinned = ranked.join(F.broadcast(totals.select("lang", share.alias("share"))), "lang").where((F.pmod("hash", F.lit(1 << 20)) < F.col("share") * (1 << 20)))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = thinned.withColumn("before", before).where(F.col("before") < train_bytes).select("lang", "text")
    counts = taken.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.collect()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text, ...).

    Only the text is looked at, all of it. A null text, a text without a letter or a model without languages gives
    lang_pred 'und' and score 0. Repeated rows are scored each; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            found = [model.predict(t.encode()) if t is not None and model.langs else ("und", 0.0) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    lettered = F.when(col("text").rlike(r"\p{L}"), col("text"))
    return docs.select(col("doc_id").cast("long").alias("doc_id"), lettered.alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    return id_crc_mod(doc_id, 4) == 2
