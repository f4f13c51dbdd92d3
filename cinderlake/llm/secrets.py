"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over mandatory trigrams is derived; the postings of the trigrams
that the rules ask for are built and intersected, and only the candidates are verified with the expression itself.
Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import col

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
MARK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """pattern: of every match, leftmost, non-overlapping; of these, keep those whose group has least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: A text without a match of this has no kept match.
    hint: str = ""


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)


def trigram_query(pattern: str):
    """A Boolean query that every lower-cased text with a match fulfils: a trigram, ('and', parts), ('or', parts), or
    None where nothing is mandatory."""

    def both(parts):
        parts = [p for p in dict.fromkeys(parts) if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))

    def of(items):
        parts, run = [], ""

        def close():
            nonlocal run
            parts.extend(run[i : i + 3] for i in range(len(run) - 2))
            run = ""

        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg).lower()
                continue
            if op is sre.SUBPATTERN and all(x[0] is sre.LITERAL for x in arg[3]):
                run += "".join(chr(x[1]).lower() for x in arg[3])
                continue
            close()
            if op is sre.SUBPATTERN:
                parts.append(of(arg[3]))
            elif op is sre.BRANCH:
                ways = [of(x) for x in arg[1]]
                parts.append(None if None in ways else ways[0] if len(set(ways)) == 1 else ("or", tuple(dict.fromkeys(ways))))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                parts.append(of(arg[2]))
        close()
        return both(parts)

    return of(sre_parser.parse(pattern))


def trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def postings(docs: DataFrame, key: Column, grams: set[str]) -> DataFrame:
    """(gram, key): the inverted index of the given trigrams over lower-cased texts."""
    lower = F.lower(col("text"))  # one expression that all searches share
    found = F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(g)), F.lit(g)) for g in sorted(grams)]))
    return docs.select(key.alias("key"), found.alias("found")).select("key", F.explode("found").alias("gram"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(key, c_<rule> boolean): whose postings fulfil which rule's query."""

    def holds(query) -> Column:
        if isinstance(query, str):
            return F.array_contains("grams", query)
        return reduce(lambda a, b: a & b if query[0] == "and" else a | b, map(holds, query[1]))

    grouped = index.groupBy("key").agg(F.collect_set("gram").alias("grams"))
    return grouped.select("key", *[holds(q).alias(f"c_{k}") for k, q in queries.items()])


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Kept matches of a rule in code points: the gaps between matches and the matches give the places."""
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    start = lambda a, x: a["at"] + F.length(x["gap"])
    span = lambda a, x: F.struct(start(a, x).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start(a, x) + F.length(x["found"])).alias("end"))
    empty = F.array().cast(SPAN)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), judged.alias("judged"))
    zipped = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["found"].alias("found"), x["judged"].alias("judged")))
    step = lambda a, x: F.struct((start(a, x) + F.length(x["found"])).alias("at"), F.when(F.length(x["judged"]) >= rule.least, F.concat(a["out"], F.array(span(a, x)))).otherwise(a["out"]).alias("out"))
    all_spans = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(rule.hint or rule.pattern), all_spans).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """record (struct of all input columns) and spans for every row of docs(doc_id, text, ...).

    spans is an array of (start, rank, kind, end), by start and then by rule; places are code points, ends exclusive.
    A null text counts as empty and has no spans. Rows are indexed by id and a hash of the text; rows that share both
    share candidates, which only adds texts to verify: each row is verified on its own text. An empty table gives an empty result."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q is not None}
    key = F.xxhash64(col("doc_id"), col("text"))  # null ids don't meet in one task
    wanted = candidates(postings(docs, key, set().union(*map(trigrams, asked.values()))), asked)
    rows = docs.select(key.alias("key"), F.coalesce(col("text"), F.lit("")).alias("t"), F.struct(*[col(c) for c in docs.columns]).alias("record"))
    joined = rows.join(wanted, "key", "left")
    parts = []
    for i, rule in enumerate(rules):
        found = spans_of(F.col("t"), rule, i)
        parts.append(F.when(F.coalesce(F.col(f"c_{rule.kind}"), F.lit(False)), found).otherwise(F.array().cast(SPAN)) if rule.kind in asked else found)
    return joined.select("record", F.sort_array(F.concat(*parts)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones as one) replaced by MARK."""
    step = lambda a, x: F.when(x["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(MARK)).alias("out"), x["end"].alias("at"))).otherwise(
        F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """docs(doc_id, text, ...) with every found span replaced by MARK and n_chars, if there, set anew; null stays null."""
    found = scan(docs, rules).withColumn("kept", redacted(F.col("record.text"), F.col("spans")))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("record").getField(c).alias(c) for c in docs.columns])
