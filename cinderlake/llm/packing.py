"""Packing: order-preserving dynamic programming over window cuts.

Documents keep their order inside a task. Windows of at most 1024 ids may be cut after a document (free), after a
sentence (a small truncation penalty) or, inside a sentence longer than LONG ids, at every LONG-th id (a large one).
The cuts minimise padding plus penalties: with D(j) the least cost of everything before cut j at id p(j),
D(j) = penalty(j) + min over p(j) - 1024 <= p(i) < p(j) of D(i) + 1024 - (p(j) - p(i)), and the minimum of D(i) + p(i)
over the sliding range comes from a monotone queue. A window whose length is a power of two isn't padded, so these
ten predecessors are looked up besides.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from cinderlake.llm.bpe import byte_symbols
from cinderlake.llm.common import col

LENGTH = 1024
SENTENCE_PENALTY, INNER_PENALTY, LONG = 2, 24, 64
#: Ids from which a block of documents is cut and packed: it bounds a task's memory. A block ends with a document and
#: begins a new window, so a block costs at most one padded window more than an endless run would.
BLOCK_IDS = 2_000_000
#: Fixed by the vocabulary: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space to Python but not to the pattern.
UNUSUAL = re.compile("[\x1c-\x1f]")
#: White space beyond ASCII in UTF-8, by its first bytes; bytes that end sentences, and what may follow them: 1 white space, 2 perhaps.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
IS_STOP = np.isin(np.arange(256), [*b".!?"])
FOLLOWS = np.isin(np.arange(256), [*b"\t\n\v\f\r "]).astype(np.int8) + 2 * np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3]).astype(np.int8)
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(data: bytes) -> np.ndarray:
    """Places behind every full stop, exclamation or question mark that white space or the end of the text follows."""
    raw = np.frombuffer(data + b" ", dtype=np.uint8)
    at = np.flatnonzero(IS_STOP[raw]) + 1
    kind = FOLLOWS[raw[at]]
    for i in np.flatnonzero(kind == 2):
        kind[i] = WIDE_SPACE.match(data, at[i]) is not None
    return at[kind == 1]


class TextTokenizer:
    """Ids of whole texts under a byte-level vocabulary file, and where sentences end among them.

    Texts that spell special tokens or hold unusual separators go to the tokenizers library; all others go to tiktoken,
    which reads the same vocabulary as ranks, in one call a text."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes([byte[c] for c in t]): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.tiktoken = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.bytes_of[list(ranks.values())] = list(map(len, ranks))

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """Little-endian ids and the places of sentence ends among them."""
        if "\0" in text or UNUSUAL.search(text) or any(s in text for s in self.special):
            return self._whole(text), []
        ids = self.tiktoken.encode_to_numpy(text, disallowed_special=())
        # No id reaches beyond white space that follows a word, so each end is the end of an id.
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), sentence_ends(text.encode())) + 1
        return ids.astype("<u4", copy=False).tobytes(), ends.tolist()


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> TextTokenizer:
    """One tokenizer for all tasks that a Python worker runs."""
    return TextTokenizer(path)


def unpadded(cuts: list[int], length: int) -> tuple[list[int], list[int]]:
    """For each cut the earlier cuts at a power of two below length from it: starts in a list of indices."""
    at = np.asarray(cuts, dtype=np.int64)
    late, early = [], []
    for k in range(length.bit_length() - 1):
        found = np.searchsorted(at, at - (1 << k))
        hit = np.flatnonzero(at[found] == at - (1 << k))
        late.append(hit)
        early.append(found[hit])
    j = np.concatenate(late)
    order = np.argsort(j, kind="stable")
    return np.searchsorted(j[order], np.arange(len(at) + 1)).tolist(), np.concatenate(early)[order].tolist()


def best_cuts(cuts: list[int], penalty: list[int], length: int = LENGTH) -> list[int]:
    """Indices of the chosen cuts, the first and the last included; neighbours among cuts are at most length apart."""
    first, exact = unpadded(cuts, length)
    cost, back = [0] * len(cuts), [0] * len(cuts)
    queue = deque([(0 + cuts[0], 0)])
    for j in range(1, len(cuts)):
        p = cuts[j]
        while cuts[queue[0][1]] < p - length:
            queue.popleft()
        least, i = queue[0]
        best = least + length - p
        for k in exact[first[j] : first[j + 1]]:
            if cost[k] + 1 < best:
                best, i = cost[k] + 1, k
        cost[j], back[j] = best + penalty[j], i
        key = cost[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    path = [len(cuts) - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def pack_block(docs: list[tuple[int, bytes, list[int]]], first_sequence: int) -> list[tuple]:
    """Pieces of documents (doc_id, ids as bytes, sentence ends) that follow one another."""
    cuts, penalty, starts, at = [0], [0], [], 0
    for _, ids, ends in docs:
        starts.append(at)
        n = len(ids) >> 2
        for e in [*ends, n]:
            last = e == n
            while at + e - cuts[-1] > LONG:
                cuts.append(cuts[-1] + LONG)
                penalty.append(INNER_PENALTY)
            if at + e > cuts[-1]:
                cuts.append(at + e)
                penalty.append(0 if last else SENTENCE_PENALTY)
            elif last:
                penalty[-1] = 0
        at += n
    out = []
    path = best_cuts(cuts, penalty)
    for s, (a, b) in enumerate(zip(path, path[1:])):
        lo, hi = cuts[a], cuts[b]
        k, offset = bisect_right(starts, lo) - 1, 0
        while lo < hi:
            doc_id, ids, _ = docs[k]
            n = len(ids) >> 2
            start = lo - starts[k]
            size = min(n - start, hi - lo)
            out.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, first_sequence + s, offset))
            lo, offset, k = lo + size, offset + size, k + 1
    return out


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per piece of every row of docs(doc_id, text, ...): where its ids lie and in which sequence.

    A document's ids are those of its text (null: empty) and one closing id 0, so every row has at least one piece;
    repeated rows are packed each. Sequence ids are unique, not gapless: they start at the task's partition times
    2**33. An empty table gives an empty result."""

    def run(batches):
        tokenize, sequence, held, size = tokenizer_of(vocabulary), TaskContext.get().partitionId() << 33, [], 0

        def flush():
            nonlocal sequence, held, size
            rows = pack_block(held, sequence)
            sequence, held, size = rows[-1][5] + 1, [], 0
            kinds = [pa.int64()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, ends = tokenize(text or "")
                held.append((doc_id, ids + END_ID.to_bytes(4, "little"), ends))
                size += (len(ids) >> 2) + 1
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).mapInArrow(run, SCHEMA)
