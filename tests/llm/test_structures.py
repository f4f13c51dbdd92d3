"""Prefix trie, structure repair and line dedup against brute force on whole strings, with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import heapq
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderlake.llm import linededup, queries, repair, trie, turns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
def brute_trie(rows):
    """rows (conv_id, turn, role, text) -> {(conv_id, depth, parent, n, children, leaves, saved, sha)}"""
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0), r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), x))
    seq = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in convs.items()}
    members = collections.defaultdict(list)
    full = {}
    for c in sorted(seq):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c >= 0 else -1))
        full[c] = tuple(seq.get(base, [])[:h] + seq[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(full[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_repair(rows, damage=True):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        spaced = [" " if v is None else v for v in (c, t, r, x)]
        k = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20 if damage else 9
        r, x = "user" if k == 4 else spaced[2], "" if k == 1 else re.sub("[.!?]", "", spaced[3]) if k == 2 else spaced[3]
        convs[c] += [] if k == 0 else [(t, r, x)] * (2 if k == 3 else 1)
    out = []
    for c, v in convs.items():
        v.sort(key=lambda w: (w[0] is not None, w[0] or 0, w[1], hashlib.md5(w[2].encode()).digest()))
        seen, faults = set(), []
        for t, r, x in v:
            y = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else "")
            seen.add((r, x))
        ts = {t for t, _, _ in v if t is not None}
        gaps = max(ts) - min(ts) + 1 - len(ts) if ts else 0
        ill = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        # Dijkstra over (cost, audit) with whole strings; state = (row, automaton state)
        heap, done = [(0, "", 0, "", ())], {}
        ans = None
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        while heap:
            cost, audit, i, st, text = heapq.heappop(heap)
            if (i, st) in done:
                continue
            done[i, st] = 1
            if i == len(v) and st in ("", "a"):
                ans = min(ans or (cost, audit, text), (cost, audit, text))
            for role in ("user", "assistant"):
                if n := step.get((st, role[0])):
                    heapq.heappush(heap, (cost + 2, audit + "I", i, n, (*text, f"{role}:")))
            if i < len(v):
                t, r, x = v[i]
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, st, text))
                if faults[i] not in ("blank", "duplicate"):
                    e = faults[i] == "truncated"
                    if n := step.get((st, r[:1])):
                        heapq.heappush(heap, (cost + e, audit + "K", i + 1, n, (*text, f"{r}:{x}")))
                    for role in ("user", "assistant"):
                        if n := step.get((st, role[0])):
                            heapq.heappush(heap, (cost + 2 + e, audit + "R", i + 1, n, (*text, f"{role}:{x}")))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), ill, ans[0], ans[1], hashlib.sha256("\n".join(ans[2]).encode()).hexdigest()))
    return sorted(out, key=repr)


UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate(UP)
def brute_lines(rows, store=None):
    holders = collections.defaultdict(set)
    for i, t in (rows if store is None else store):
        for l in (t or "").split("\n"):
            if len(key(l)) >= 10: holders[key(l)].add((i is None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [l for l in lines if len(key(l)) < 10 or len(h := holders[key(l)]) < 2 or min(h) == (i is None, i or 0)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string, row string"


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


def talks(seed, convs):
    rnd = random.Random(seed)
    say = ["a b. ", "c", "d!", "e?", "f.\n", None, "", *(f"x{i}." for i in range(6))]
    who = ["user", "assistant"] * 3 + ["system", None, "odd", ""]
    return [(c, rnd.choice([t, t, t, None]), rnd.choice(who), rnd.choice(say)) for c in convs for t in range(rnd.randint(1, 9))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA).repartition(3)


@pytest.fixture()
def many_parts(spark):
    """Partitions as on a cluster: conversations lie across their boundaries."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_positions(spark, many_parts):
    """One conversation with a third of all rows, many of them equal, lies in several parts."""
    rows = [(c, t) for c in (None, 1, 2, 3) for t in (None, 1, 2)] + [(2, t % 40) for t in range(300)] + [(2, 7)] * 60
    placed = turns.in_order(spark.createDataFrame(rows, "c long, t long").repartition(5), "c", [F.asc_nulls_first("t")])
    got = placed.collect()
    assert len(got) == len(rows) and len({r._part for r in got if r.c == 2}) > 1
    for c in (None, 1, 2, 3):
        mine = sorted((r._at, r.t is not None, r.t or 0, r._rows, r._part) for r in got if r.c == c)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:3] for m in mine] == sorted(m[1:3] for m in mine)
        assert {m[3] for m in mine} <= {len(mine)} and [m[4] for m in mine] == sorted(m[4] for m in mine)
        assert {r._apart for r in got if r.c == c} == {len({m[4] for m in mine}) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, many_parts, seed):
    rows = [r for r in talks(seed, [*range(-25, 60), 200, 1000, 10**15]) if (r[0] + seed) % 7] + [(41, t, "user", "w w") for t in range(200)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(3)] * 2 + [(None, 1, "user", "x")]
    got = rows_of(trie.prefix_trie(frame(spark, rows)), NODE)
    assert got == brute_trie(rows)
    assert rows_of(trie.prefix_trie(frame(spark, [])), NODE) == [] == rows_of(trie.prefix_trie(frame(spark, [(None, 1, "a", "b")])), NODE)


def test_ends_of_many_families(spark, monkeypatch):
    """A node's list of ends comes from several blocks, in order."""
    monkeypatch.setattr(trie, "BLOCK_FAMILIES", 2)
    rows = [(c, 0, "user", "same") for c in range(0, 400, 3)]
    assert rows_of(trie.prefix_trie(frame(spark, rows)), NODE) == brute_trie(rows)


def repaired(spark, rows, damage):
    df = frame(spark, rows)
    broken = repair.damaged(df) if damage else df
    edits = repair.audits(repair.pieces_of(broken))
    return rows_of(repair.report(df, broken, edits), REPORT), repair.repaired_turns(broken, edits).collect()


@pytest.mark.parametrize("piece", [2, 4096])
@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, many_parts, monkeypatch, piece, damage):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = talks(5, [None, *range(-4, 150)])
    rows += [(500, t, "user" if t % 3 else "assistant", f"{t // 2}" + "." * (t % 5)) for t in range(90)] + [(501, 3, "user", "same.")] * 9
    if not damage:
        rows = [(c, t, r or "", x or "") for c, t, r, x in rows]
    got, said = repaired(spark, rows, damage)
    want = brute_repair(rows, damage)
    assert got == want
    # The repaired turns are the text behind each digest, and their roles follow the pattern.
    lines, roles = collections.defaultdict(list), collections.defaultdict(str)
    for r in sorted(said, key=lambda r: (repr(r.conv_id), r.n)):
        assert r.n == len(lines[r.conv_id]) + 1
        lines[r.conv_id].append(f"{r.role}:{r.text}")
        roles[r.conv_id] += r.role[0]
    assert {r[0]: r[8] for r in want} == {r[0]: hashlib.sha256("\n".join(lines[r[0]]).encode()).hexdigest() for r in want}
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_repair_empty(spark):
    assert repaired(spark, [], True) == ([], [])
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 1, "user", "x.")], True)[0] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_layers_stay_few():
    """A long conversation meets a bounded number of layers, so a row is a look-up."""
    program, rnd = repair.Program(), random.Random(1)
    for start in range(4):
        for _ in range(20):
            program.run(start, bytes(rnd.choices(range(16), k=2000)))
    assert len(program.layers) < 400


def test_cuckoo_filters():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (30000, 2), dtype=np.uint64)
    filters = linededup.Cuckoo()
    for lo, hi in ((0, 3000), (3000, 3000), (3000, 9000), (9000, 30000)):
        filters.add(keys[lo:hi])
    filters.add(keys[:1])
    assert len(filters.tables) > 1 and filters.holds(keys).all()
    assert filters.holds(rng.integers(0, 2**63, (100000, 2), dtype=np.uint64)).mean() < 0.002
    back = linededup.Cuckoo.load(filters.dump())
    back.remove(keys[:15000])
    assert back.holds(keys[15000:]).all() and back.holds(keys[1:15000]).mean() < 0.002
    back.remove(keys[15000:])
    back.remove(keys[:1])
    assert not any(t.any() for t in back.tables)


def test_equal_prints_leave_one_by_one():
    """Keys that the filter can't tell apart are held once each; more than two buckets hold go into a further filter."""
    keys = np.tile(np.array([[5, 7]], np.uint64), (11, 1))
    filters = linededup.Cuckoo()
    filters.add(keys)
    assert len(filters.tables) > 1 and sum(int((t > 0).sum()) for t in filters.tables) == 11
    for left in range(10, -1, -1):
        filters.remove(keys[:1])
        assert sum(int((t > 0).sum()) for t in filters.tables) == left and filters.holds(keys[:1]).all() == (left > 0)


DOCS = "doc_id long, text string, doc string, key string"


def kept(store, df):
    return rows_of(store.deduplicated(df).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("s")), ["doc_id", "n_lines", "n_dropped", "s"])


@pytest.fixture(scope="module")
def lined():
    rnd = random.Random(4)
    pool = [f"Line number {i} of pool" for i in range(40)] + ["short", "", "  ", "İstanbul line LONG", "éé éé éé éé", "x" * 5000]
    text = lambda i: "\n".join(rnd.choice([x, x.upper(), "\t" + x + " \r", f"own {i} line {rnd.random()}"]) for x in rnd.choices(pool, k=rnd.randint(0, 12)))
    return [(rnd.choice([i, i, i, None, 5]), rnd.choice([None, "", *(text(i) for _ in range(9))])) for i in range(80)]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "z", "z") for r in rows], DOCS).repartition(3)


@pytest.mark.parametrize("batches", [1, 3])
def test_lines(spark, lined, batches):
    df, store = docs_of(spark, lined), linededup.LineStore()
    assert kept(store, df) == brute_lines(lined, [])
    for n in range(batches):
        store.insert(df.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == n))
    assert kept(store, df) == brute_lines(lined)


def test_lines_are_reversible(spark, lined, monkeypatch):
    monkeypatch.setattr(linededup, "FIRST_BUCKETS", 2)
    df, store = docs_of(spark, lined), linededup.LineStore(3)
    store.delete(df)
    for n in range(2):
        store.insert(df.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == n))
    out = {*sorted({r[0] for r in lined if r[0] is not None})[::3], None}
    rest = [r for r in lined if r[0] not in out]
    store.delete(spark.createDataFrame([(i,) for i in out] + [(99999,)], "doc_id long"))
    assert kept(store, docs_of(spark, rest)) == brute_lines(rest)
    # The filters hold as many fingerprints as there are live keys, and know each of these.
    filters = {r.shard: linededup.Cuckoo.load(r.blob) for r in store.filters.collect()}
    live = [(r.shard, bytes(r.key)) for r in store.counts.collect()]
    assert sum(int((t > 0).sum()) for f in filters.values() for t in f.tables) == len(live)
    assert all(filters[s].holds(np.frombuffer(k, np.uint64).reshape(1, 2)).all() for s, k in live)
    store.insert(docs_of(spark, [r for r in lined if r[0] in out]))
    assert kept(store, df) == brute_lines(lined)
    store.delete(df)
    assert store.counts.count() == 0
    assert not any(t.any() for r in store.filters.collect() for t in linededup.Cuckoo.load(r.blob).tables)


def test_false_positives_are_counted_exactly(spark, lined, monkeypatch):
    """A filter that takes every key for a held one changes no result, and every key can still leave."""

    def told(batches):
        for b in batches:
            keys = b.filter(b.column(2).is_valid())
            yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(2), keys.column(3)], names=["shard", "key", "blob"])

    monkeypatch.setattr(linededup, "told", told)
    df, store = docs_of(spark, lined), linededup.LineStore(2)
    for n in range(2):
        store.insert(df.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == n))
    assert kept(store, df) == brute_lines(lined)


def test_lines_of_nothing(spark):
    df, store = docs_of(spark, []), linededup.LineStore()
    store.insert(df)
    store.insert(df)
    assert kept(store, df) == [] and kept(store, docs_of(spark, [(1, None)])) == brute_lines([(1, None)])


def test_registered(spark, tmp_path, lined):
    """The queries apply the operators to their whole tables."""
    said = [r for r in talks(3, range(60))]
    frame(spark, said).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    docs_of(spark, lined).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()
    assert rows_of(found["op11_prefix_trie"](spark, str(tmp_path)), NODE) == brute_trie(said)
    assert rows_of(found["op12_structure_repair"](spark, str(tmp_path)), REPORT) == brute_repair(said)
    assert rows_of(found["op13_line_dedup"](spark, str(tmp_path)), ["doc_id", "n_lines", "n_dropped", "kept_sha256"]) == brute_lines(lined)


def test_patterned_words_do_not_collide(spark):
    """Words of 2048 letters that follow a Thue-Morse pattern and its complement share nothing."""
    from cinderlake.llm import jaccard

    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, word.upper(), f"{word} {other}", f"{other} {word}", " ".join([word] * 6), " ".join([other] * 6)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(rows).collect()} == {0: (1, 0), 1: (1, 1), 2: (1, 0), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (1, 6)}


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, missing ids and texts without words."""
    from cinderlake.llm import jaccard

    rnd = random.Random(1)
    say = lambda: " ".join("".join(rnd.choices("abcdef", k=5)) for _ in range(60))
    a, b, c = say(), say(), say()
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, near(a)), (2, near(a)), (1, b), (3, near(b)), (None, near(b)), (None, c), (None, near(c)), (None, c), (None, None), (None, None), (None, " "), (4, None), (4, None), (4, ""), (5, " ")]
    got = sorted(map(tuple, jaccard.deduplicated(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, no_id string")).select("doc_id", "text").collect()), key=repr)
    first = lambda *texts: min(texts, key=lambda t: hashlib.md5(t.encode()).digest())
    want = [(1, first(a, near(a))), (1, b), (None, first(c, near(c))), (None, None), (None, None), (None, " "), (4, None), (5, " ")]
    assert [g for g in got if g[0] != 4] == sorted((w for w in want if w[0] != 4), key=repr)
    assert sum(g[0] == 4 for g in got) == 1 and all(not (t or "").strip() for i, t in got if i == 4)


def test_as_many_rows_stay_as_there_are_components(spark):
    """Groups of one to five near copies, some linked only through one another."""
    from cinderlake.llm import jaccard

    rnd = random.Random(7)
    rows = []
    for _ in range(150):
        words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(rnd.choice([8, 30, 120]))]
        for _ in range(rnd.randint(1, 5)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rnd.randrange(len(words))] = f"w{rnd.random()}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    components = {r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert {r.doc_id for r in jaccard.deduplicated(docs).collect()} == components


def test_texts_are_tokenized_whole():
    from cinderlake.llm import packing

    tokenize = packing.TextTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    calls, encode = [], tokenize.tiktoken.encode_to_numpy
    tokenize.tiktoken = SimpleNamespace(encode_to_numpy=lambda text, **more: calls.append(text) or encode(text, **more))
    texts = ["One two. Three!  Four?\nv1.2 é.　Next. x.  y.é end.", "", ".", "a.\x1fb. c", "x<|endoftext|>. y"]
    for text in texts:
        ids, ends = tokenize(text)
        assert ids == tokenize._whole(text)
        cut = [tokenize.library.decode(list(memoryview(ids).cast("I")[:e]), skip_special_tokens=False) for e in ends]
        assert cut == ([] if text in texts[3:] else [text[: m.end()] for m in re.finditer(r"[.!?](?=\s|$)", text)])
    assert calls == texts[:3]
