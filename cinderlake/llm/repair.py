"""Repair of a conversation's structure by rank-compressed dynamic programming.

A repaired conversation has the role initials (s?(ua)+)?. Four states follow it: nothing yet (0), after s (1), after u (2),
after a (3). One macro edit a row inserts a run of up to two turns (longer ones only come back to a state already passed) and
keeps, reroles or deletes the row. Written I*X with X of D, K, R, these codes are prefix-free, so audits that cover
the same rows compare by the rank of what precedes the last code, then by that code. A layer of the program therefore is four
costs and four ranks; audits are read off parent pointers afterwards.

Relative costs and ranks take few values, so layers are numbered as they appear and a row costs a look-up. Rows are dealt as
pieces of PIECE letters. Each piece is solved from every state it may begin in, the pieces of a conversation are put together
from sixteen costs and ranks each, and each piece is then retraced by itself: a long conversation is many tasks.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import col, materialize
from cinderlake.llm.turns import in_order

#: Rows of a conversation that are solved together.
PIECE = 4096
BLANK_CHARS = " \t\n\x0b\x0c\r"
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
#: Costs of a delete, a rerole, an insert and of an undeleted truncated row.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: State after each initial, by the state before it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
CODES = sorted("I" * k + x for k in range(3) for x in "DKR")
#: Inserts that end a conversation from each state; they reach an accepting one.
TAIL = ("", "II", "I", "")
ROLE = {2: "user", 3: "assistant"}
Layer = tuple[tuple[int, int] | None, ...]


def letter_moves(letter: int) -> list[list[tuple[int, int, int]]]:
    """For a kind of row, by state: (cost, number of the code, next state) of each macro edit, the best of each next state."""
    initial, fault = (*INITIALS, "")[letter % 4], FAULTS[letter // 4]
    out = []
    for state in range(4):
        best: dict[int, tuple[int, int]] = {}
        for n, code in enumerate(CODES):
            at, runs = state, len(code) - 1
            for _ in range(runs):
                at = 3 if at == 2 else 2
            cost = runs * INSERT
            if code[-1] == "D":
                cost += DELETE
            elif fault in ("blank", "duplicate") or code[-1] == "K" and initial not in NEXT[at]:
                continue
            else:
                cost += TRUNCATED * (fault == "truncated") + REROLE * (code[-1] == "R")
                at = NEXT[at][initial] if code[-1] == "K" else 3 if at == 2 else 2
            best[at] = min(best.get(at, (cost, n)), (cost, n))
        out.append([(cost, n, at) for at, (cost, n) in best.items()])
    return out


class Program:
    """The layers met so far, by number, and what each kind of row makes of them."""

    def __init__(self):
        self.moves = [letter_moves(x) for x in range(16)]
        self.number: dict[Layer, int] = {}
        self.layers: list[Layer] = []
        self.steps: list[list] = []
        self.starts = [self.known(tuple((0, 0) if q == p else None for q in range(4))) for p in range(4)]

    def known(self, layer: Layer) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.layers)
            self.layers.append(layer)
            self.steps.append([None] * 16)
        return self.number[layer]

    def step(self, layer: int, letter: int) -> tuple[int, int, tuple]:
        """(next layer, cost to add to its relative costs, (state before, code) by state)."""
        best: list = [None] * 4
        for p, held in enumerate(self.layers[layer]):
            if held is None:
                continue
            for cost, code, q in self.moves[letter][p]:
                found = (held[0] + cost, held[1], code, p)
                if best[q] is None or found < best[q]:
                    best[q] = found
        # From state 3, or 2 and an insert, every way on from 1 is open at no more, and from 0 at one delete more.
        bound = min([b[0] + extra for b, extra in ((best[3], 0), (best[2], INSERT)) if b] or [1 << 60])
        for q, slack in ((0, DELETE), (1, 0)):
            if best[q] is not None and best[q][0] > bound + slack:
                best[q] = None
        low = min(b[0] for b in best if b)
        order = sorted((b[1], b[2], q) for q, b in enumerate(best) if b)
        rank = {q: i for i, (_, _, q) in enumerate(order)}
        new = self.known(tuple((b[0] - low, rank[q]) if b else None for q, b in enumerate(best)))
        self.steps[layer][letter] = found = (new, low, tuple((b[3], b[2]) if b else None for b in best))
        return found

    def run(self, start: int, letters: bytes) -> tuple[Layer, int]:
        """The last layer from a state over a piece, and the cost to add to its costs."""
        at, total, steps = self.starts[start], 0, self.steps
        for x in letters:
            at, more, _ = steps[at][x] or self.step(at, x)
            total += more
        return self.layers[at], total

    def retrace(self, start: int, end: int, letters: bytes) -> str:
        """The best audit of a piece from one state to another."""
        at, steps, ways = self.starts[start], self.steps, []
        for x in letters:
            at, _, way = steps[at][x] or self.step(at, x)
            ways.append(way)
        codes = []
        for way in reversed(ways):
            end, code = way[end]
            codes.append(CODES[code])
        return "".join(reversed(codes))


def put_together(pieces: list[tuple[Layer, ...]]) -> tuple[int, list[tuple[int, int]]]:
    """(cost with the tail, (first, last state) of each piece) of the best audit through pieces given by start state."""
    layer: Layer = ((0, 0), None, None, None)
    ways = []
    for piece in pieces:
        best: list = [None] * 4
        for p, held in enumerate(layer):
            for q, inner in enumerate(piece[p]) if held is not None else ():
                if inner is not None:
                    found = (held[0] + inner[0], held[1], inner[1], p)
                    best[q] = found if best[q] is None else min(best[q], found)
        order = sorted((b[1], b[2], q) for q, b in enumerate(best) if b)
        rank = {q: i for i, (_, _, q) in enumerate(order)}
        layer = tuple((b[0], rank[q]) if b else None for q, b in enumerate(best))
        ways.append([b and b[3] for b in best])
    cost, _, end = min((held[0] + INSERT * len(TAIL[q]), held[1], q) for q, held in enumerate(layer) if held)
    states = []
    for way in reversed(ways):
        states.append((way[end], end))
        end = way[end]
    return cost, states[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the contract's damage by crc32(conv_id:turn) % 20; nulls count as one space."""
    or_space = lambda n: F.coalesce(col(n).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", or_space("conv_id"), or_space("turn"))) % 20
    rows = conversations.select(col("conv_id").alias("conv_id"), col("turn").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def row_digest() -> Column:
    return F.unhex(F.md5("text"))


def row_order() -> list[Column]:
    """Order of a conversation's rows: turn (null first), then role and MD5 of the text."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def pieces_of(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, turn, role, digest, letters): a letter for each row's initial and first fault; the key is the first row's."""
    rows = rows.select("conv_id", "turn", "role", "text").fillna("", ["role", "text"])
    last = F.substring(F.rtrim("text", F.lit(BLANK_CHARS)), -1, 1)
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    slim = rows.select("conv_id", "turn", "role", row_digest().alias("digest"), F.when(F.col("role") == "", 3).otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))).alias("initial"), fault.alias("fault"))
    placed = in_order(slim, "conv_id", row_order())
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("_at").alias("_first")).select(F.col("conv_id").alias("_c"), "_first")
    met = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_at") == F.col("_first")), "left")
    fault = F.when((F.col("fault") != 1) & F.col("_first").isNull(), 2).otherwise(F.col("fault"))
    letter = F.char(F.lit(97) + F.col("initial") + 4 * fault)
    met = met.select("conv_id", F.floor(F.col("_at") / PIECE).alias("piece"), "_at", "turn", "role", "digest", letter.alias("letter"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "letter"))), lambda x: x["letter"]), "")
    key = F.min_by(F.struct("turn", "role", "digest"), "_at").alias("key")
    return materialize(met.groupBy("conv_id", "piece").agg(key, letters.alias("letters")).select("conv_id", "piece", "key.*", "letters"), "letters")


def numbers(letters: str) -> bytes:
    return bytes(x - 97 for x in letters.encode())


def batch_of(rows: list[tuple], like: pa.Schema, more: dict[str, pa.DataType]) -> pa.RecordBatch:
    """rows as a batch; the first columns have the types that the input has."""
    fields = [*like, *(pa.field(n, t) for n, t in more.items())]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def audits(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, turn, role, digest, audit, cost, blank, duplicate, truncated, illegal), written; sums in a conversation's last piece.

    An audit's last piece has the closing inserts."""
    kind = dict(pieces.dtypes)["conv_id"]
    legal = {("s", "u"), ("u", "a"), ("a", "u")}

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program()
        for batch in batches:
            done = []
            for conv, piece, letters in zip(*(batch.column(i).to_pylist() for i in range(3))):
                letters, table = numbers(letters), []
                for start in range(4):
                    layer, more = program.run(start, letters)
                    table += [x for held in layer for x in ((-1, -1) if held is None else (held[0] + more, held[1]))]
                initials = [(*INITIALS, "")[x % 4] for x in letters]
                illegal = sum((a, b) not in legal for a, b in zip(initials, initials[1:]))
                counts = [sum(x // 4 == f for x in letters) for f in (1, 2, 3)]
                done.append((conv, piece, table, [*counts, illegal, letters[0] % 4, letters[-1] % 4]))
            yield batch_of(done, pa.schema(list(batch.schema)[:2]), {"costs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())})

    solved = pieces.select("conv_id", "piece", "letters").mapInArrow(solve, f"conv_id {kind}, piece long, costs array<long>, counts array<long>")

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, schema = object(), [], None

        def chosen() -> list[tuple]:
            if not held:
                return []
            tables = [tuple(tuple((t[8 * p + 2 * q], t[8 * p + 2 * q + 1]) if t[8 * p + 2 * q] >= 0 else None for q in range(4)) for p in range(4)) for _, t, _ in held]
            cost, states = put_together(tables)
            sums = [sum(c[i] for _, _, c in held) for i in range(4)]
            sums[3] += sum(((*INITIALS, "")[a[5]], (*INITIALS, "")[b[4]]) not in legal for (_, _, a), (_, _, b) in zip(held, held[1:]))
            rows = [(now, piece, *way, None, None, None, None, None) for (piece, _, _), way in zip(held, states)]
            rows[-1] = (*rows[-1][:4], cost, *sums)
            return rows

        for batch in batches:
            schema, done = batch.schema, []
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    done += chosen()
                    now, held = conv, []
                held.append(rest)
            yield batch_of(done, pa.schema(list(schema)[:2]), MORE)
        if schema is not None:
            yield batch_of(chosen(), pa.schema(list(schema)[:2]), MORE)

    MORE = {n: pa.int64() for n in ("first", "last", "cost", "blank", "duplicate", "truncated", "illegal")}
    ways = solved.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(choose, f"conv_id {kind}, piece long, " + ", ".join(f"{n} long" for n in MORE))
    ways = ways.withColumnsRenamed({"conv_id": "_c", "piece": "_p"})

    def retrace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program()
        for batch in batches:
            at = {n: batch.column(n) for n in ("letters", "first", "last", "cost")}
            audit = []
            for letters, first, last, cost in zip(*(c.to_pylist() for c in at.values())):
                audit.append(program.retrace(first, last, numbers(letters)) + (TAIL[last] if cost is not None else ""))
            kept = [n for n in batch.schema.names if n not in ("letters", "first", "last")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(audit, pa.string())], names=[*kept, "audit"])

    met = pieces.join(ways, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p"))).drop("_c", "_p")
    types = dict(met.dtypes)
    names = [n for n in met.columns if n not in ("letters", "first", "last")]
    return materialize(met.mapInArrow(retrace, ", ".join(f"`{n}` {types[n]}" for n in names) + ", audit string"), "audits")


def stream(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, audit, role, text): rows and audits dealt by conversation and in order; audits come before their first row."""
    none = F.lit(None).cast("string")
    program = edits.select("conv_id", "turn", "role", "digest", "piece", "audit", none.alias("text"))
    body = rows.fillna("", ["role", "text"]).select("conv_id", "turn", "role", row_digest().alias("digest"), F.lit(None).cast("long").alias("piece"), none.alias("audit"), "text")
    dealt = program.unionByName(body).repartition("conv_id")
    return dealt.sortWithinPartitions(F.asc_nulls_first("conv_id"), *row_order(), F.asc_nulls_last("piece")).select("conv_id", "audit", "role", "text")


def edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, edit, role, text) of each repaired turn, and (conv, None, None, None) where a batch ends.

    One conversation streams through; only audits that wait for their rows are held, a letter a row."""
    waiting: deque[str] = deque()
    now, state, at = object(), 0, 0

    def inserts():
        nonlocal state, at
        while waiting:
            if at == len(waiting[0]):
                waiting.popleft()
                at = 0
            elif waiting[0][at] == "I":
                at += 1
                state = 3 if state == 2 else 2
                yield now, "I", ROLE[state], ""
            else:
                return

    for batch in batches:
        for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now:
                yield from inserts()
                now, state, at = conv, 0, 0
            if audit is not None:
                waiting.append(audit)
                continue
            yield from inserts()
            edit = waiting[0][at]
            at += 1
            if edit == "D":
                continue
            state = NEXT[state][role[0]] if edit == "K" else 3 if state == 2 else 2
            yield now, edit, role if edit == "K" else ROLE[state], text
        yield now, None, None, None
    yield from inserts()


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, n, edit, role, text): every repaired turn, numbered from 1 in its conversation; edit is K, R or I."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        schema, now, n, held = None, object(), 0, []
        batches = iter(batches)

        def watched():
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield b

        for conv, edit, role, text in edited(watched()):
            if edit is not None:
                now, n = conv, n + 1 if conv == now else 1
                held.append((conv, n, edit, role, text))
            elif held:
                yield batch_of(held, pa.schema([schema.field(0)]), MORE)
                held = []
        if held:
            yield batch_of(held, pa.schema([schema.field(0)]), MORE)

    MORE = {"n": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
    return stream(rows, edits).mapInArrow(run, f"conv_id {kind}, n long, edit string, role string, text string")


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired role:text lines; conversations without any repaired turn are missing.

    SHA-256 runs through a conversation from end to end, so this is one stream a conversation, in bounded memory."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        schema, now, running = None, object(), None

        def watched():
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield b

        done = []
        for conv, edit, role, text in edited(watched()):
            if edit is None:
                if done:
                    yield batch_of(done, pa.schema([schema.field(0)]), {"repaired_sha256": pa.string()})
                done = []
            elif conv != now:
                if running is not None:
                    done.append((now, running.hexdigest()))
                now, running = conv, hashlib.sha256(f"{role}:{text}".encode())
            else:
                running.update(f"\n{role}:{text}".encode())
        if running is not None:
            yield batch_of([*done, (now, running.hexdigest())], pa.schema([schema.field(0)]), {"repaired_sha256": pa.string()})

    return stream(rows, edits).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of `conversations`.

    rows are what is repaired, edits their audits. A conversation whose rows are all gone has zeros, an empty audit and the digest
    of the empty string. Null is a conversation like others; a role without a first letter can't be kept. Rows of
    equal turn go by role and MD5 of the text. Null roles and texts count as empty. gaps is null where it exceeds a long."""
    wide = lambda c: c.cast("decimal(20,0)")
    span = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv_id").agg(F.when(F.max("turn").isNull(), F.lit(0)).otherwise(span).try_cast("long").alias("gaps"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    found = edits.groupBy("conv_id").agg(*[F.max(n).alias(n) for n in sums], audit.alias("audit"))
    parts = [conversations.select(col("conv_id").alias("conv_id")).distinct(), gaps.withColumn("seen", F.lit(True)), found, repaired_digests(rows, edits)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    zero = lambda n: F.coalesce(F.max(n), F.lit(0).cast("long")).alias(n)
    kept = F.when(F.max("seen"), F.max("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps")
    text = lambda n, other: F.coalesce(F.max(n), F.lit(other)).alias(n)
    return both.groupBy("conv_id").agg(kept, *map(zero, sums), text("audit", ""), text("repaired_sha256", hashlib.sha256(b"").hexdigest()))
