"""BPE encoding by a depth-first walk over the trie of distinct words, and decoding.

The encoding of a string ends in exactly one token whose pairing with the last token of the shorter prefix is itself
a valid encoding. So each trie node needs only the last token of its prefix: it is found from the states of the nodes
above, once for all words that share the prefix, and a word's tokens are read back by hopping up the states.
Distinct words are sorted, which walks their trie depth first with the current path's states as a stack.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cinderlake.llm.common import col

#: Fixed by the word_bpe_49k vocabulary: how a text without white space is split, and the marker of a word's end.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
END = "</w>"
#: White space as regular expressions of the library see it; Python's own also takes U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
CACHE_WORDS = 500_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TrieEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.length = {i: len(t.removesuffix(END)) for t, i in self.vocab.items()}
        self.starts = {t[:k] for t in self.vocab for k in range(1, len(t.removesuffix(END)) + 1)}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.symbols = byte_symbols()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE of a few symbols: always the merge of least rank, leftmost first."""
        rank, none = self.rank.get, 1 << 30
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return parts

    def _symbols(self, token: int) -> list[str]:
        text = self.token[token]
        if text.endswith(END) and len(text) > len(END):
            text = text.removesuffix(END)
            return [*text[:-1], text[-1] + END]
        return list(text)

    def _reaches(self, token: int) -> bool:
        if token not in self.alone:
            self.alone[token] = self.merge(self._symbols(token)) == [self.token[token]]
        return self.alone[token]

    def _fits(self, left: int, right: int) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            known = self.merge(self._symbols(left) + self._symbols(right)) == [self.token[left], self.token[right]]
            if len(self.pairs) > 4 * CACHE_WORDS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _last(self, word: str, n: int, longest: int, states: list[int], end: str) -> int:
        """The last token of word[:n] (plus the end marker), given the states of all shorter prefixes."""
        for size in range(longest, 0, -1):
            token = self.vocab.get(word[n - size : n] + end)
            if token is not None and (self._reaches(token) if size == n else self._fits(states[n - size], token)):
                return token
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode_words(self, words) -> dict[str, bytes]:
        """Ids of each distinct word (in byte symbols), packed."""
        out, before, states, reach = {}, "", [-1], [0]
        starts = self.starts
        for word in sorted(words):
            n = len(word)
            shared = 0
            top = min(n - 1, len(states) - 1)
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], reach[shared + 1 :]
            for k in range(shared + 1, n):
                size = reach[-1] + 1  # of the longest suffix with which some token starts: no token ends here that is longer
                while word[k - size : k] not in starts:
                    size -= 1
                reach.append(size)
                states.append(self._last(word, k, size, states, ""))
            token = self._last(word, n, reach[-1] + 1, states, END)
            back, at = [token], n - self.length[token]
            while at > 0:
                back.append(states[at])
                at -= self.length[states[at]]
            out[word] = struct.pack(f"<{len(back)}I", *back[::-1])
            before = word
        return out

    def _learn(self, words: set[str]) -> None:
        """Put the ids of every blank-free word into the cache, those of new parts all through one trie walk.

        Caches have two generations, so what is met often stays and memory is bounded."""
        if len(self.cache) > CACHE_WORDS:
            self.old, self.cache = self.cache, {}
        if len(self.parts) > CACHE_WORDS:
            self.parts = {}
        split = {}
        for w in [w for w in words if w not in self.cache]:
            if (ids := self.old.get(w)) is not None:
                self.cache[w] = ids
                continue
            split[w] = [w] if w.isascii() and w.isalpha() else [p if p.isascii() and p.isprintable() else "".join([self.symbols[b] for b in p.encode()]) for p in SPLIT.findall(w)]
        parts = self.parts
        parts.update(self.encode_words({p for found in split.values() for p in found if p not in parts}))
        for w, found in split.items():
            self.cache[w] = parts[found[0]] if len(found) == 1 else b"".join([parts[p] for p in found])

    def _pieces(self, text: str) -> list:
        """Blank-free lower-case words of a text, and the ids of special tokens that it spells out."""
        if "<|" not in text:
            return self._words(text)
        out: list = []
        for part in self.special_pattern.split(text):
            out += [self.special[part]] if part in self.special else self._words(part)
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter, no final sigma
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in SPACE.split(text) if w]
        return text.split()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        pieces = [self._pieces(t) for t in texts]
        out: list[bytes] = []
        start = 0
        while start < len(pieces):  # in groups whose distinct words fit the cache
            words, end = set(), start
            while end < len(pieces) and (end == start or len(words) < CACHE_WORDS // 2):
                words.update(x for x in pieces[end] if isinstance(x, str)) if "<|" in texts[end] else words.update(pieces[end])
                end += 1
            self._learn(words)
            cache = self.cache
            for t, p in zip(texts[start:end], pieces[start:end]):
                out.append(b"".join([cache[x] if isinstance(x, str) else struct.pack("<I", x) for x in p]) if "<|" in t else b"".join([cache[x] for x in p]))
            start = end
        return out

    def decode(self, ids) -> str:
        """The vocabulary's decoder: its token strings, one blank between."""
        token = self.token
        return " ".join([token[i] for i in ids])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> TrieEncoder:
    """One encoder for all tasks that a Python worker runs, so its caches stay warm."""
    return TrieEncoder(path)


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded) for every row of docs(doc_id, text, ...); a null text is empty.

    An empty text has no ids and decodes to the empty text. Repeated rows are encoded each, and an empty table gives
    an empty result. Each task keeps one encoder, so a word met again costs one look-up."""

    def run(batches):
        encoder = encoder_of(vocabulary)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            ids = [memoryview(b).cast("I") if b else () for b in encoder.encode_batch(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(x) for x in ids], pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode_decode gives, digested where it is made."""

    def run(batches):
        encoder = encoder_of(vocabulary)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            ids = encoder.encode_batch(["" if t is None else t for t in batch.column(1).to_pylist()])
            decoded = [sha(encoder.decode(memoryview(b).cast("I") if b else ()).encode()) for b in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
