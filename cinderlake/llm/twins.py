"""DuckDB SQL for those corpus queries that SQL expresses at bearable cost on small tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"

#: reach holds every row that a row reaches by links; the smallest names the component.
OP4 = rf"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_SHINGLES} END AS s FROM cut),
members AS (SELECT doc_id, unnest(s) AS x FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM members a JOIN members b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * c >= 75 * (sa.n + sb.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sizes UNION SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.node)
SELECT doc_id, n AS n_shingles, min(seen) AS component_id FROM sizes JOIN reach ON node = doc_id GROUP BY ALL
"""

OP5 = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, min(seen)::BIGINT AS component_id, vec_id = min(seen) AS kept
FROM embeddings JOIN reach ON node = vec_id LEFT JOIN counted ON a = vec_id GROUP BY vec_id, n
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {bits}), 4294967295)"


OP11 = rf"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT c, turn, r, md5(length(r)::VARCHAR || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM t),
own AS (SELECT c, list(struct_pack(k := k, w := w) ORDER BY turn NULLS FIRST, r, k) AS turns FROM named GROUP BY c),
heads AS (SELECT c, turns, {_crc32("c::VARCHAR")} % 4 AS h FROM own),
whole AS (SELECT a.c, list_concat(coalesce(b.turns[1:h], a.turns[1:0]), a.turns[h + 1:]) AS s FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 20),
steps AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM whole),
path AS (SELECT c, d, array_to_string(list_transform(s[1:d], lambda x: x.k), '') AS k, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w, len(s) = d AS ends FROM steps),
node AS (SELECT k, d, min(c) AS c, count(*) AS n, any_value(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS e FROM path GROUP BY k, d),
kids AS (SELECT left(k, 32 * (d - 1)) AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids USING (k, d)),
up AS (SELECT left(k, 32 * i) AS k, i AS d, sum((kids = 0)::BIGINT) AS leaves, sum((n - 1) * w) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM full_) GROUP BY ALL)
SELECT full_.c AS conv_id, full_.d AS depth, parent.c AS parent_conv_id, full_.n AS n_convs, full_.kids AS n_children, up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(full_.e) AS ends_sha256
FROM full_ JOIN up USING (k, d) LEFT JOIN node parent ON parent.k = left(full_.k, 32 * (full_.d - 1)) AND parent.d = full_.d - 1
"""


def _repair() -> str:
    """Whole audits and texts by state, row by row: b0 to b3 hold the least (cost, audit) after nothing, s, u and a."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    role = {2: "user", 3: "assistant"}
    found: dict[int, list[str]] = {q: [] for q in after}
    for p in after:
        at, added = p, ""
        for k in range(3):
            step = lambda q, cost, edit, line, when: found[q].append(f"CASE WHEN b{p} IS NOT NULL AND {when} THEN struct_pack(cost := b{p}.cost + {2 * k} + {cost}, audit := b{p}.audit || '{'I' * k + edit}', body := b{p}.body || {added or "''"}{line}) END")  # noqa: B023, E731
            step(at, 3, "D", "", "true")
            for initial, q in after[at].items():
                step(q, "late", "K", " || r || ':' || x || chr(10)", f"can AND left(r, 1) = '{initial}'")
            q = 3 if at == 2 else 2
            step(q, "2 + late", "R", f" || '{role[q]}:' || x || chr(10)", "can")
            at, added = q, added + (" || " if added else "") + f"'{role[q]}:' || chr(10)"
    states = ", ".join(f"list_min([{', '.join(v)}]) AS b{q}" for q, v in found.items())
    tails = {0: ("", ""), 1: ("II", "'user:' || chr(10) || 'assistant:' || chr(10)"), 2: ("I", "'assistant:' || chr(10)"), 3: ("", "")}
    ends = ", ".join(f"CASE WHEN b{q} IS NOT NULL THEN struct_pack(cost := b{q}.cost + {2 * len(i)}, audit := b{q}.audit || '{i}', body := b{q}.body || {body or chr(39) * 2}) END" for q, (i, body) in tails.items())
    none = "NULL::STRUCT(cost BIGINT, audit VARCHAR, body VARCHAR)"
    return rf"""
WITH RECURSIVE c0 AS (SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
c1 AS (SELECT c, t, CASE WHEN k = 4 THEN 'user' ELSE r END AS r, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS x, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS twice FROM c0 WHERE k <> 0),
c2 AS (SELECT c, t, r, x, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, r, md5(x)) AS n, rtrim(x, {_BLANK}) AS y FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY c, r, x ORDER BY n) > 1 AS again, lag(left(r, 1)) OVER (PARTITION BY c ORDER BY n) || left(r, 1) AS two FROM c2),
c4 AS (SELECT *, y = '' AS blank, y <> '' AND again AS dup, y <> '' AND NOT again AND right(y, 1) NOT IN ('.', '!', '?') AS trunc FROM c3),
c5 AS (SELECT *, NOT blank AND NOT dup AS can, trunc::INT AS late FROM c4),
dp AS (SELECT c, 0::BIGINT AS n, struct_pack(cost := 0::BIGINT, audit := '', body := '') AS b0, {none} AS b1, {none} AS b2, {none} AS b3 FROM (SELECT DISTINCT c FROM c5)
  UNION ALL SELECT c5.c, c5.n, {states} FROM dp JOIN c5 ON c5.c IS NOT DISTINCT FROM dp.c AND c5.n = dp.n + 1),
best AS (SELECT c, list_min([{ends}]) AS b FROM dp JOIN (SELECT c AS c_, max(n) AS last FROM c5 GROUP BY c) ON c IS NOT DISTINCT FROM c_ AND n = last),
sums AS (SELECT c, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM c5 GROUP BY c)
SELECT a.c AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(left(b.body, length(b.body) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT c FROM c0) a LEFT JOIN best ON best.c IS NOT DISTINCT FROM a.c LEFT JOIN sums ON sums.c IS NOT DISTINCT FROM a.c
"""


OP12 = _repair()

OP13 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, h.first IS NOT NULL AND h.first <> doc_id AS bad FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
