"""Removal of long repeats: run-compressed Burrows-Wheeler index over everything that may repeat.

A byte goes if some `length`-byte string that covers it also starts elsewhere in the corpus. Spark narrows the corpus
to what may repeat, and the index then finds the repeats:

1. Equal texts become one, with their number.
2. Every window of `length` bytes chooses one anchor, the k-gram of least hash in it. Equal windows choose equal
   anchors, so a window can only repeat where its anchor's hash does. Windows that follow one another and share an
   anchor form a segment; segments whose anchor occurs once are done.
3. Segments are read back once for each distinct content. For those that share an anchor a run-length index is built:
   the runs of their Burrows-Wheeler transform with the suffix sampled at both ends of every run. Matching statistics
   are streamed from the samples along the text; starts whose longest match reaches `length` repeat.
4. Anchors shared by more distinct segments than one task should hold are finished by counting window digests in a
   distributed aggregate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import bucketed, col, join_hot, materialize

LENGTH, GRAM = 200, 40
#: Bytes hashed at once, bytes of segments indexed at once, and distinct segments of an anchor that one task may hold.
PIECE, INDEX_BYTES, GROUP_SEGMENTS = 1 << 20, 1 << 20, 3000
BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each place."""
    n = len(data)
    power = np.full(n, BASE, dtype=np.uint64)
    power[0] = 1
    summed = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(power), out=summed[1:])
    back = np.full(n - k + 1, INVERSE, dtype=np.uint64)
    back[0] = 1
    h = (summed[k:] - summed[:-k]) * np.cumprod(back)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring keys, from running minima inside blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def segments_of(pieces: list[tuple[int, int, bytes]], length: int, k: int):
    """(owner, start in its text, windows, anchor hash) of every segment of pieces (owner, offset, bytes)."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    if len(data) < length:
        return
    hashes = gram_hashes(data, k)
    keys = (hashes >> np.uint64(28) << np.uint64(28)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_least(keys, length - k + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    at = 0
    for owner, offset, b in pieces:
        if (n := len(b) - length + 1) > 0:
            mine = anchor[at : at + n]
            cut = np.flatnonzero(np.diff(mine)) + 1
            starts = np.concatenate([[0], cut])
            counts = np.diff(np.concatenate([starts, [n]]))
            for s, c, h in zip(starts.tolist(), counts.tolist(), hashes[mine[starts]].astype(np.int64).tolist()):
                yield owner, offset + s, c, h
        at += len(b)


def pieces_of(owner: int, text: bytes, length: int):
    """A text in pieces that overlap so that every window lies in exactly one."""
    for i in range(0, max(1, len(text) - length + 1), PIECE):
        yield owner, i, text[i : i + PIECE + length - 1]


class RunIndex:
    """The Burrows-Wheeler transform of many strings as runs, with the suffix sampled at both ends of every run.

    Kept for each run: its byte, its length, and at its head (tail) the text position and the length of the match with
    the suffix before (after) it in order. The suffix array is needed only to build this and isn't kept."""

    def __init__(self, strings: list[bytes]):
        s = len(strings)
        self.ends = np.cumsum([len(x) + 1 for x in strings])
        self.n = n = int(self.ends[-1])
        data = np.zeros(n, dtype=np.int64)
        data[:] = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
        data += s
        data[self.ends - 1] = np.arange(s)  # each end is its own, smallest symbol
        order = self._sorted_suffixes(data, s + 256)
        before = data[order - 1]
        new = np.concatenate([[True], (np.diff(before) != 0) | (before[1:] < s)])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:] - 1, [n - 1]])
        self.byte, self.length = before[head] - s, tail - head + 1  # ends are negative
        self.heads = self._sampled(data, order[head], order[head - 1], head > 0)
        self.tails = self._sampled(data, order[tail], order[np.minimum(tail + 1, n - 1)], tail < n - 1)

    @staticmethod
    def _sorted_suffixes(data: np.ndarray, width: int) -> np.ndarray:
        """Suffix array by doubling; ends differ, so the order becomes total."""
        n = len(data)
        place = np.arange(n)
        shift = lambda r, d: r[np.minimum(place + d, n - 1)]
        key = (data * width + shift(data, 1)) * width + shift(data, 2)
        span = 3
        while True:
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
            if step[-1] == n - 1:
                return order
            rank = np.empty(n, dtype=np.int64)
            rank[order] = step
            key = rank * n + shift(rank, span)
            span *= 2

    @staticmethod
    def _sampled(data: np.ndarray, a: np.ndarray, b: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions a in order, with the lengths of their matches with b, compared byte by byte."""
        n, match = len(data), np.zeros(len(a), dtype=np.int64)
        left, reach = np.flatnonzero(valid), 0
        while len(left):
            x = data[np.minimum(a[left, None] + reach + np.arange(8), n - 1)]
            y = data[np.minimum(b[left, None] + reach + np.arange(8), n - 1)]
            same = x == y
            whole = same.all(axis=1)
            match[left] += np.where(whole, 8, same.argmin(axis=1))
            left = left[whole]
            reach += 8
        at = np.argsort(a)
        return a[at], match[at]

    def matching_statistics(self, portion: int = 1 << 16):
        """(first position, longest match with any other suffix from each position on), streamed along the text.

        Inside a run the match with either neighbour in order shrinks by one a byte, so the last sample decides."""
        for lo in range(0, self.n, portion):
            at = np.arange(lo, min(lo + portion, self.n))
            best = np.zeros(len(at), dtype=np.int64)
            for where, match in (self.heads, self.tails):
                k = np.searchsorted(where, at, side="right") - 1
                best = np.maximum(best, np.where(k >= 0, match[k] - (at - where[k]), 0))
            yield lo, best


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, the starts of its `length`-byte windows that also start elsewhere in the segments."""
    index = RunIndex(segments)
    hits = np.concatenate([lo + np.flatnonzero(best >= length) for lo, best in index.matching_statistics()])
    owner = np.searchsorted(index.ends, hits, side="right")
    first = np.concatenate([[0], index.ends[:-1]])
    return np.split(hits - first[owner], np.searchsorted(owner, np.arange(1, len(segments))))


def runs(starts: np.ndarray) -> list[list[int]]:
    """Maximal runs [first, number] of neighbouring starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([first, [len(starts)]]))
    return np.stack([starts[first], size], axis=1).tolist()


SEGMENT = "key binary, h long, seg long, start int, windows int"


def mark(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, t, copies, spans) for each distinct text of docs(text, ...): its maximal removed runs [start, bytes].

    key is text_key(text). A null text counts as empty; texts shorter than `length` have no spans. Equal texts of at
    least `length` bytes are removed whole, each of them. An empty table gives an empty result."""
    rows = docs.select(F.coalesce(col("text"), F.lit("")).alias("t"))
    distinct = rows.select(text_key(F.col("t")).alias("key"), "t").groupBy("key").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    # Bucketed by key: the two later joins with this table don't shuffle its texts again.
    texts = bucketed(distinct, "key", "texts")

    def anchors(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            held, size, found = [], 0, []
            bodies = [t.encode() for t in batch.column(1).to_pylist()]

            def flush():
                for owner, start, count, h in segments_of(held, length, gram):
                    body = bodies[owner][start : start + count + length - 1]
                    found.append((keys[owner], h, int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True), start, count))
                held.clear()

            for i, body in enumerate(bodies):
                if len(body) < length:
                    continue
                for piece in pieces_of(i, body, length):
                    held.append(piece)
                    size += len(piece[2])
                    if size >= PIECE:
                        flush()
                        size = 0
            flush()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "h", "seg", "start", "windows"])

    every = materialize(texts.select("key", "t").mapInArrow(anchors, SEGMENT), "segments")
    # Rows of hot anchors and of hot segments stay where they are; the others are dealt.
    again = materialize(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    open_ = materialize(join_hot(every, again.select("h"), "h", counts=again), "shared")
    kinds = materialize(open_.groupBy("h", "seg").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "windows")).alias("one")), "kinds")
    mixed = materialize(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    wanted = join_hot(kinds, mixed, "h", counts=mixed.withColumnRenamed("kinds", "n")).select("h", "seg", "kinds", "one.*")
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "seg", "kinds", "start", "windows")).alias("asked"))

    def bodies(batches):
        for batch in batches:
            out = []
            for t, list_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = t.encode()
                out += [(a["h"], a["seg"], a["kinds"], body[a["start"] : a["start"] + a["windows"] + length - 1]) for a in list_]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["h", "seg", "kinds", "body"])

    read = materialize(texts.join(asked, "key").select("t", "asked").mapInArrow(bodies, "h long, seg long, kinds long, body binary"), "bodies")

    def index(batches):
        held, size = [], 0

        def flush():
            found = [(h, seg, runs(r)) for (h, seg, _), r in zip(held, repeated_starts([x[2] for x in held], length)) if len(r)]
            held.clear()
            hs, segs, lists = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(segs, pa.int64()), pa.array(lists, pa.list_(pa.list_(pa.int64())))], names=["h", "seg", "starts"])

        last = None
        for batch in batches:
            for h, seg, body in zip(*[c.to_pylist() for c in batch.columns]):
                if h != last and size >= INDEX_BYTES:
                    yield flush()
                    size = 0
                held.append((h, seg, body))
                size, last = size + len(body), h
        if held:
            yield flush()

    few = read.where(F.col("kinds") <= GROUP_SEGMENTS).select("h", "seg", "body").repartition("h").sortWithinPartitions("h", "seg").mapInArrow(index, "h long, seg long, starts array<array<long>>")

    def windows(batches):
        for batch in batches:
            for h, seg, body in zip(*[c.to_pylist() for c in batch.columns]):
                n = len(body) - length + 1
                digests = [hashlib.blake2b(body[i : i + length], digest_size=12).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([seg] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(digests, pa.binary())], names=["h", "seg", "i", "d"])

    spread = read.where(F.col("kinds") > GROUP_SEGMENTS).select("h", "seg", "body").mapInArrow(windows, "h long, seg long, i long, d binary")
    twice = spread.groupBy("d").count().where("count > 1").select("d")
    many = spread.join(twice, "d").groupBy("h", "seg").agg(F.collect_list(F.array(F.col("i"), F.lit(1).cast("long"))).alias("starts"))
    marks = few.union(many)
    whole = kinds.where("n > 1").select("h", "seg", F.lit(True).alias("whole"))
    hit = materialize(marks.join(whole, ["h", "seg"], "full"), "hits")
    # One join gives every segment its repeated starts, wherever it stands.
    spans = join_hot(open_, hit, "h", "seg", counts=kinds).select("key", F.when(F.col("whole"), F.array(F.array(F.col("start").cast("long"), F.col("windows").cast("long")))).otherwise(F.transform("starts", lambda r: F.array(F.col("start") + r[0], r[1]))).alias("r"))
    spans = spans.groupBy("key").agg(F.flatten(F.collect_list("r")).alias("starts"))

    def merge(batches):
        for batch in batches:
            out = []
            for t, copies, starts in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                n = len(t.encode())
                joined: list[list[int]] = []
                for s, c in [[0, n - length + 1]] if copies > 1 and n >= length else sorted(starts or []):
                    if joined and s <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s + c + length - 1)
                    else:
                        joined.append([s, s + c + length - 1])
                out.append([[a, b - a] for a, b in joined])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.list_(pa.int64())))], names=["key", "t", "copies", "spans"])

    return texts.join(spans, "key", "left").select("key", "t", "copies", "starts").mapInArrow(merge, "key binary, t string, copies long, spans array<array<long>>")


def text_key(text):
    """96 bits that stand for a text."""
    return F.substring(F.unhex(F.md5(text.cast("binary"))), 1, 12)


def kept_bytes(text: str, spans) -> bytes:
    body, out, at = text.encode(), [], 0
    for start, n in spans:
        out.append(body[at:start])
        at = start + n
    return b"".join([*out, body[at:]])


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text, ...)."""

    def digest(batches):
        for batch in batches:
            out = [(len(t.encode()), sum(n for _, n in s), len(s), hashlib.sha256(kept_bytes(t, s)).hexdigest()) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = mark(docs, length).select("key", "t", "spans").mapInArrow(digest, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rows = docs.select(col("doc_id").alias("doc_id"), text_key(F.coalesce(col("text"), F.lit(""))).alias("key"))
    return rows.join(done, "key", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(text, ...) with every removed run cut out of its text and n_chars, if there, set anew.

    Characters that a run cuts in two go as well. Null texts stay null."""

    def cut(batches):
        for batch in batches:
            kept = [kept_bytes(t, s).decode(errors="ignore") if s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["_key", "_kept"])

    done = mark(docs, length).select("key", "t", "spans").mapInArrow(cut, "_key binary, _kept string")
    rest = docs.select(F.struct(*[col(c) for c in docs.columns if c != "text"]).alias("rest"), col("text").isNull().alias("none"), text_key(F.coalesce(col("text"), F.lit(""))).alias("key"))
    joined = rest.join(done, F.col("key") == F.col("_key"), "left").withColumn("_kept", F.when(~F.col("none"), F.col("_kept")))
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else F.col("rest").getField(c).alias(c) for c in docs.columns])
