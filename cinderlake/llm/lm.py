"""Language-model scoring by the subword lattice.

A text is its words, each written with a leading mark, and an end. The pieces of an existing vocabulary get
probabilities, first from the scores that the vocabulary gives them and then by expectation-maximisation over the
training words; a text's probability is the sum over all its segmentations, from a forward recursion in log space.
No piece reaches across a word's start, so the sum is a product over words and each distinct word is worked out once.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import col, id_crc_mod, materialize

MARK = "▁"
#: At most so many of the most frequent words have their figures held by every task: a fixed bound. All other words are
#: looked up by a join.
COMMON_WORDS = 65_536
EM_ROUNDS = 2
#: Taken off every training count and given to the lattice, in the way of absolute discounting.
DISCOUNT = 0.75
LN10 = math.log(10)
#: Distinct words that a task counts before it hands them on.
FLUSH_WORDS = 300_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Cells of the lattice that are worked out at once, and characters from which a word is worked out by stretches.
CELLS, LONG_WORD = 4_000_000, 4096
#: What the vocabulary's own scores count for in EM, in uses: they stay a prior of the pieces' weights.
PRIOR_USES = 100_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, cut at blank, tab, line feed, vertical tab, form feed, carriage return."""
    return (text or "").encode().translate(LOWER).split()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[str], list[float]]:
    """Pieces of a sentencepiece model that stand for text, then one per byte; and their initial weights.

    The scores of a BPE vocabulary are ranks of merges, not log probabilities, so weights start inversely to ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or MARK in piece[1:]):
            pieces.append(piece)
            weights.append(1 / (10 - model.get_score(i)))
    return pieces, weights


class Lattice:
    """Log probabilities of pieces, looked up for all substrings of many words of equal length at once.

    Byte pieces spell characters that no piece has."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str], log_p: list[float]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        self.log_p = np.asarray(log_p)
        keys = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.size = 1 << 20
        self.slot_key, self.slot_id = np.zeros(self.size, dtype=np.uint64), np.full(self.size, -1, dtype=np.int32)
        left, self.probes = np.arange(self.n), 0
        while len(left):  # open addressing, all keys of a round at once
            place = self._place(keys[left], self.probes)
            free = np.flatnonzero(self.slot_id[place] < 0)
            _, first = np.unique(place[free], return_index=True)
            take = free[first]
            self.slot_key[place[take]], self.slot_id[place[take]] = keys[left[take]], left[take]
            left, self.probes = np.delete(left, take), self.probes + 1

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _place(self, h: np.ndarray, probe: int) -> np.ndarray:
        return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64) + probe) & (self.size - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        place = self._place(h, 0)
        out = np.where(self.slot_key[place] == h, self.slot_id[place], -1)
        left = np.nonzero((out < 0) & (self.slot_id[place] >= 0))
        for probe in range(1, self.probes):
            if not len(left[0]):
                break
            place = self._place(h[left], probe)
            same = (self.slot_key[place] == h[left]) & (self.slot_id[place] >= 0)
            out[left] = np.where(same, self.slot_id[place], -1)
            left = tuple(x[~same & (self.slot_id[place] >= 0)] for x in left)
        return out

    def edges(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: piece ids (or -1) and log probabilities of the substrings from each start."""
        out, h, n = [], np.zeros(codes.shape, dtype=np.uint64), codes.shape[1]
        for size in range(1, min(self.longest, n) + 1):
            h = h[:, : n - size + 1] * self.STEP + codes[:, size - 1 :] + np.uint64(1)
            ids = self._find(h)
            lp = np.where(ids >= 0, self.log_p[ids], -np.inf)
            if size == 1 and (ids < 0).any():
                for c in np.unique(codes[ids < 0]).tolist():
                    lp[codes == c] = sum(self.log_p[self.n + b] for b in chr(c).encode())
            out.append((ids, lp))
        return out

    @staticmethod
    def total(terms: list[np.ndarray]) -> np.ndarray:
        """log of summed exponentials, term by term."""
        t = np.stack(terms)
        top = t.max(axis=0)
        return top + np.log(np.exp(t - top).sum(axis=0))

    def forward(self, edges: list, n: int) -> np.ndarray:
        """alpha[:, j]: log probability that pieces spell the first j characters, over all segmentations."""
        alpha = np.zeros((len(edges[0][0]), n + 1))
        for j in range(1, n + 1):
            alpha[:, j] = self.total([alpha[:, j - k] + edges[k - 1][1][:, j - k] for k in range(1, min(len(edges), j) + 1)])
        return alpha

    def _blocks(self, words: list[str]):
        """Indices and codes of words of equal length, in blocks of bounded size; each word gets its mark."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) < LONG_WORD:
                by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            step = max(1, CELLS // ((n + 1) * self.longest))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                text = "".join([MARK + words[i] for i in part])
                yield part, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(part), n + 1).astype(np.uint64)

    def long_score(self, word: str) -> float:
        """forward() of one long word: edges of a stretch at a time, and only the last alphas are kept."""
        codes = np.frombuffer((MARK + word).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        alpha = deque([0.0], maxlen=self.longest)  # of the latest places, the last one at the end
        for lo in range(0, len(codes), LONG_WORD):
            first = max(0, lo - self.longest + 1)
            hi = min(lo + LONG_WORD, len(codes))
            edges = [lp[0].tolist() for _, lp in self.edges(codes[None, first:hi])]
            for j in range(lo + 1, hi + 1):
                terms = []
                for k in range(1, min(len(edges), len(alpha)) + 1):
                    lp = edges[k - 1][j - k - first]
                    if lp > -math.inf:
                        terms.append(alpha[-k] + lp)
                top = max(terms)
                alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha[-1]

    def scores(self, words: list[str]) -> np.ndarray:
        """log10 of each word's probability over all its segmentations."""
        out = np.zeros(len(words))
        for at, codes in self._blocks(words):
            out[at] = self.forward(self.edges(codes), codes.shape[1])[:, -1] / LN10
        for i, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[i] = self.long_score(w) / LN10
        return out

    def expect(self, words: list[str]) -> np.ndarray:
        """Expected uses of each piece in the words, each taken once; long words are taken as stretches of LONG_WORD - 1."""
        uses, step = np.zeros(self.n + 256), LONG_WORD - 1
        words = [w[i : i + step] for w in words for i in range(0, max(1, len(w)), step)]
        for _, codes in self._blocks(words):
            edges, n = self.edges(codes), codes.shape[1]
            alpha = self.forward(edges, n)
            beta = np.zeros((len(codes), n + 1))
            for i in range(n - 1, -1, -1):
                beta[:, i] = self.total([edges[k - 1][1][:, i] + beta[:, i + k] for k in range(1, min(len(edges), n - i) + 1)])
            for k, (ids, lp) in enumerate(edges, 1):
                use = np.exp(alpha[:, : n - k + 1] + lp + beta[:, k:] - alpha[:, -1:])
                known = ids >= 0
                uses += np.bincount(ids[known], weights=use[known], minlength=self.n + 256)
                if k == 1:
                    for c in np.unique(codes[~known]).tolist():
                        for b in chr(c).encode():
                            uses[self.n + b] += use[codes == c].sum()
        return uses


def in_portions(batches, rows: int = 50_000):
    """Columns of Arrow batches, joined to portions of about so many rows."""
    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def count_words(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """(word, c, seen): occurrences in training documents and in all, of every distinct word of docs."""

    def run(batches):
        train, rest = Counter(), Counter()

        def flush():
            keys = [*train, *(w for w in rest if w not in train)]
            c, seen = [train[w] for w in keys], [train[w] + rest[w] for w in keys]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in keys], pa.string()), pa.array(c, pa.int64()), pa.array(seen, pa.int64())], names=["word", "c", "seen"])
            train.clear()
            rest.clear()

        for batch in batches:
            for held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (rest if held_out else train).update(words_of(text))
            if len(train) + len(rest) > FLUSH_WORDS:
                yield from flush()
        if train or rest:
            yield from flush()

    part = docs.select((id_crc_mod(col("doc_id"), modulus) == held).alias("h"), col("text").alias("text")).mapInArrow(run, "word string, c long, seen long")
    return part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def fit(counts: DataFrame, path: str, rounds: int = EM_ROUNDS) -> list[float]:
    """Log probabilities of the pieces: those of the vocabulary's scores as a prior, and EM over all distinct training
    words, as the lattice has to explain kinds of words, not their repetitions. Only one sum a piece leaves the
    executors in each round."""
    pieces, weights = vocabulary(path)
    n, whole = len(pieces), sum(weights)
    prior = [PRIOR_USES * w / whole + 0.1 for w in weights] + [0.01] * 256
    used: dict[int, float] = {}
    for r in range(rounds + 1):
        mass = [p + used.get(i, 0.0) for i, p in enumerate(prior)]
        whole = math.log(sum(mass))
        log_p = [math.log(m) - whole for m in mass]
        if r == rounds:
            break
        shared = counts.sparkSession.sparkContext.broadcast(log_p)

        def expect(batches, shared=shared):
            lattice = Lattice(vocabulary(path)[0], shared.value)
            uses = sum((lattice.expect(t.column(0).to_pylist()) for t in in_portions(batches)), np.zeros(n + 256))
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at])], names=["piece", "n"])

        rows = counts.where("c > 0").select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        used = {x["piece"]: x["n"] for x in rows}
    return log_p


def steps(count: Column) -> Column:
    """A count's place on a scale of sixteen steps for each doubling, so that all counts take about a thousand places."""
    return F.floor(F.log2(count) * 16)


def least_step(counts: DataFrame, most: int) -> int:
    """The lowest step from which on at most so many words lie; words of one step go in together or not at all.

    Only numbers of words by step reach the driver, whatever the number of partitions."""
    least, inside = 1 << 20, 0
    for r in counts.groupBy(steps(F.col("seen")).alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        inside += r["n"]
        if inside > most:
            break
        least = r["step"]
    return least


def score(docs: DataFrame, path: str, modulus: int = 7, held: int = 2) -> DataFrame:
    """One row per row of docs(doc_id, text, ...), learnt from those whose crc32(doc_id) mod modulus isn't held.

    Returns doc_id, held_out, n_tokens (words and the end), n_known, train_tokens, base_score (log10, add-one unigram
    words), score (log10 of the lattice's marginal probability: over all segmentations of every word into weighted
    pieces, times that of the end) and mixed_score (log10; a token's discounted share of the training tokens as a
    whole, plus the discounted mass spread over all strings by the lattice). A null or empty text is the end alone.
    Repeated rows are scored each; an empty table gives an empty result, and without training rows every count is 0."""
    counts = materialize(count_words(docs, modulus, held), "words")
    n_docs = docs.where(id_crc_mod(col("doc_id"), modulus) != held).count()
    kinds, tokens = counts.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0))).first()
    tokens, kinds = tokens + n_docs, kinds + (n_docs > 0)
    shared = docs.sparkSession.sparkContext.broadcast(fit(counts, path))
    base = lambda c: math.log10((c + 1) / (tokens + kinds + 1))
    freed = math.log10(DISCOUNT * kinds / tokens) if tokens else 0.0
    # Texts end once, words never do: the end takes its add-one share, and every word the rest.
    end = (n_docs + 1) / (tokens + 2)
    end_lp, word_lp = math.log10(end), math.log10(1 - end)

    def weigh(batches):
        lattice = Lattice(vocabulary(path)[0], shared.value)
        for t in in_portions(batches):
            lp = lattice.scores(t.column(0).to_pylist()) + word_lp
            c = t.column(1).to_numpy().astype(np.float64)
            whole = np.log10(np.maximum(c - DISCOUNT, 1e-300) / max(tokens, 1))
            low = freed + lp
            high = np.maximum(whole, low)
            mixed = np.where(c > 0, high + np.log10(10 ** (whole - high) + 10 ** (low - high)), low)
            yield from t.append_column("lp", pa.array(lp)).append_column("mixed", pa.array(mixed)).to_batches()

    weighed = materialize(counts.mapInArrow(weigh, "word string, c long, seen long, lp double, mixed double"), "weights")
    common = weighed.where(steps(F.col("seen")) >= least_step(weighed, COMMON_WORDS))
    top = common.select("word", "c", "lp", "mixed").collect()
    figures = np.array([(r["c"] > 0, base(r["c"]), r["lp"], r["mixed"]) for r in top], dtype=np.float64).reshape(-1, 4)
    held_top = docs.sparkSession.sparkContext.broadcast(({r["word"].encode(): i for i, r in enumerate(top)}, figures))
    end_known, end_base = n_docs > 0, base(n_docs)
    end_mixed = math.log10(n_docs / tokens) if n_docs else 0.0

    def rows(batches):
        place, figures = held_top.value
        ends, at = np.array([float(end_known), end_base, end_lp, end_mixed]), TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "held_out", "n", "word", "known", "base", "lp", "mixed"]
        kinds_ = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 3]
        for batch in batches:
            docs_, tails = [], []
            for doc_id, held_out, text in zip(*[c.to_pylist() for c in batch.columns]):
                tokens_ = words_of(text)
                found = np.fromiter(map(place.get, tokens_, repeat(-1)), np.int64, len(tokens_))
                tails += [(at, None, None, k, w.decode(), None, None, None, None) for w, k in Counter(compress(tokens_, found < 0)).items()]
                known, *sums = (figures[found[found >= 0]].sum(axis=0) + ends).tolist()
                docs_.append((at, doc_id, held_out, len(tokens_) + 1, None, int(known), *sums))
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*docs_, *tails), kinds_)], names=names)

    wanted = docs.select(col("doc_id").cast("long").alias("doc_id"), (id_crc_mod(col("doc_id"), modulus) == held).alias("held_out"), col("text").alias("text"))
    parts = materialize(wanted.mapInArrow(rows, "row long, doc_id long, held_out boolean, n long, word string, known long, base double, lp double, mixed double"), "parts")
    tail = parts.where("word is not null").select("row", "word", "n").join(weighed.select("word", "c", "lp", "mixed"), "word")
    tail_base = F.log10((F.col("c") + 1) / F.lit(float(tokens + kinds + 1)))
    times = lambda c: F.col("n") * c
    tail = tail.select("row", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), times(tail_base).alias("base"), times(F.col("lp")).alias("lp"), times(F.col("mixed")).alias("mixed"))
    whole = parts.where("word is null").select("row", "known", "base", "lp", "mixed", "doc_id", "held_out", "n").unionByName(tail, allowMissingColumns=True)
    summed = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score"), F.sum("mixed").alias("mixed_score"))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score", "mixed_score")
