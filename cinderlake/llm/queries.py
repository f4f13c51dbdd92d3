"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm import bpe, embed_dedup, jaccard, langid, linededup, lm, packing, quality, repair, repeats, secrets, sharding, trie, twins
from cinderlake.llm.common import id_crc_mod, small_batches

SHARDS = 24
#: Batches in which op13 gets the documents, as an incremental store does.
BATCHES = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = sharding.external_shuffle(documents(spark, sf_dir).select("doc_id", "text"), SHARDS)
    text = F.col("record.text")
    return shuffled.select("record.doc_id", sharding.record_size(text).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), carry=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(documents(spark, sf_dir).select("doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("record.doc_id", *map(n, kinds), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.prefix_trie(conversations(spark, sf_dir))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = conversations(spark, sf_dir)
    rows = repair.damaged(whole)
    return repair.report(whole, rows, repair.audits(repair.pieces_of(rows)))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    store = linededup.LineStore()
    for n in range(BATCHES):
        store.insert(docs.where(id_crc_mod(F.col("doc_id"), BATCHES) == n))
    return store.deduplicated(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_language_id, op3_quality_rules, op4_ngram_jaccard, op5_embedding_dedup, op6_bpe, op7_lm_scoring, op8_packing, op9_suffix_dedup, op10_secret_scan, op11_prefix_trie, op12_structure_repair, op13_line_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard": twins.OP4, "op5_embedding_dedup": twins.OP5, "op11_prefix_trie": twins.OP11, "op12_structure_repair": twins.OP12, "op13_line_dedup": twins.OP13}
