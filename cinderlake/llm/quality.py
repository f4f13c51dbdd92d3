"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns (at most 3 to the
number of rules, whatever the corpus holds) estimates how each class votes; a document is kept if the posterior
probability of good reaches one half. This replaces a filter that every rule must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import WORD, WORD_GAP, col, materialize

#: Words of a window, and the failing share of words in windows found twice.
WINDOW, REPEAT_PERCENT, MIN_WORDS = 8, 30, 20
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Prior of the vote shares (bad, abstain, good) of bad and of good documents, worth PRIOR_SHARE of all documents:
#: it tells the two classes apart and keeps the estimates alike at every size, but data outweigh it.
PRIOR_BAD, PRIOR_GOOD, PRIOR_SHARE = (0.3, 0.3, 0.4), (0.01, 0.2, 0.79), 0.01
#: Probability of good before the first round, by the number of bad votes; the last also for more of them.
START = (0.95, 0.8, 0.02)


def text_statistics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """row (struct of the carried input columns, by default all) with counts over the whole text of each document.

    A null or empty text has no words, so every count is 0. Rows are never merged: repeated rows stay repeated."""
    step = docs.select(F.struct(*[col(c) for c in carry or docs.columns]).alias("row"), F.coalesce(col("text"), F.lit("")).alias("t"))
    step = step.select("row", "t", F.array_remove(F.split("t", WORD_GAP), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    n = F.size("w")
    joined = F.array_join("w", "")
    less = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    step = step.select(
        "row", n.cast("long").alias("n_words"), F.length(joined).cast("long").alias("word_chars"),
        less(F.col("t"), "[#*$%&|<>]").cast("long").alias("n_symbols"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("t") - F.length(F.replace(F.col("t"), F.lit("!"), F.lit("")))).alias("n_marks"),
        less(joined, r"\p{Lu}").alias("n_upper"), less(joined, r"\p{L}").alias("n_letters"), F.size(F.filter("w", lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).alias("n_bare"),
        F.size(F.array_distinct("w")).alias("n_distinct"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    for half in (1, 2, 4):  # from hashes of `half` words to hashes of twice as many
        left = F.greatest(F.size("h") - half, F.lit(0))
        step = step.withColumn("h", F.zip_with(F.slice("h", F.lit(1), left), F.slice("h", F.lit(1 + half), left), lambda a, b: F.xxhash64(a, b)))
    empty = F.array().cast("array<struct<v:bigint,i:int>>")
    pairs = F.transform("h", lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    step = step.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(pairs)).otherwise(empty)).drop("h")
    twice = F.filter("s", lambda e, k: (e["v"] == F.get("s", k - 1)["v"]) | (e["v"] == F.get("s", k + 1)["v"]))
    step = step.withColumn("p", F.sort_array(F.transform(twice, lambda e: e["i"]))).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return step.withColumn("n_repeat_words", covered).drop("p")


def rules() -> dict[str, Column]:
    """Each rule's vote, from the columns of text_statistics. Every kind of junk is in sight of two rules or more."""
    c, words, chars = F.col, F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    vote = lambda bad, good: F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
    ratio = lambda name: c(name) / words
    spread = F.log(F.greatest(c("n_distinct"), F.lit(1))) / F.log(F.greatest(words, F.lit(2)))
    return {
        "length": vote(c("n_words") < 50, c("n_words") >= 100),
        "symbols": vote(ratio("n_symbols") > 0.1, ratio("n_symbols") < 0.03),
        "letters": vote(c("n_letters") < 0.8 * chars, c("n_letters") > 0.9 * chars),
        "bare_words": vote(ratio("n_bare") > 0.1, ratio("n_bare") < 0.03),
        "lines": vote(c("n_dup_lines") * 4 > c("n_lines"), (c("n_dup_lines") == 0) & (c("n_lines") > 1)),
        "repeats": vote(ratio("n_repeat_words") > 0.3, ratio("n_repeat_words") <= 0.15),
        "variety": vote(spread < 0.6, spread > 0.7),
        "word_length": vote((ratio("word_chars") < 2) | (ratio("word_chars") > 15), ratio("word_chars").between(3, 10)),
        "capitals": vote(c("n_upper") > 0.3 * chars, c("n_upper") < 0.15 * chars),
        "marks": vote(ratio("n_marks") > 0.2, ratio("n_marks") < 0.03),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list]:
    """EM over (votes, documents) patterns; returns the prior of good and rates[rule][class][vote].

    Each round takes the likeliest rates under the Dirichlet priors above, so a rule that calls many documents bad
    which the others find good loses weight, and its lone vote is outvoted."""
    k = len(patterns[0][0]) if patterns else 0
    bad_votes = [sum(x == BAD for x in v) for v, _ in patterns]
    post = [START[min(n, len(START) - 1)] for n in bad_votes]
    total = sum(n for _, n in patterns)
    weight = 1 + PRIOR_SHARE * total
    prior, rates = 0.5, [[list(PRIOR_BAD), list(PRIOR_GOOD)] for _ in range(k)]
    for _ in range(rounds):
        good = sum(p * n for p, (_, n) in zip(post, patterns))
        prior = (good + 0.9 * weight) / (total + weight)
        for j in range(k):
            seen = [[weight * x for x in PRIOR_BAD], [weight * x for x in PRIOR_GOOD]]
            for p, (v, n) in zip(post, patterns):
                seen[1][v[j]] += p * n
                seen[0][v[j]] += (1 - p) * n
            rates[j] = [[x / sum(s) for x in s] for s in seen]
        post = []
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[j][1][x] / rates[j][0][x]) for j, x in enumerate(v))
            post.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
    return prior, rates


def judge(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Statistics, votes and verdict of every row of docs(doc_id, text, ...).

    Returns row (struct of the carried input columns, by default all; they are written once), the counts of text_statistics, p_good double, base_failed and kept.
    A document fails the base with fewer than 20 words or over 30 % of its words in repeated 8-word windows, and is
    then never kept. An empty table gives an empty result."""
    ruled = rules()
    counted = text_statistics(docs, carry).withColumn("votes", F.array(*[v.cast("int") for v in ruled.values()]))
    counted = materialize(counted, "quality")
    seen = [(tuple(r["votes"]), r["count"]) for r in counted.groupBy("votes").count().orderBy("votes").collect()]
    prior, rates = fit(seen)
    odds = F.lit(math.log(prior / (1 - prior)))
    for j in range(len(ruled)):
        gain = F.array(*[F.lit(math.log(rates[j][1][v] / rates[j][0][v])) for v in (BAD, ABSTAIN, GOOD)]) if seen else F.array(*[F.lit(0.0)] * 3)
        odds = odds + F.get(gain, F.get("votes", F.lit(j)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = counted.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
