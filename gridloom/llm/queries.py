"""The queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, lexical, mining


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages for the row that comes later, and, with first, once more for the one that it repeats; of a class of
    rows that passages join (class_id) not each two are listed."""
    from .common import cut
    from .passages import repeated_passages

    got = cut(repeated_passages(table(spark, sf_dir, "documents"), classes=True).drop("k"), "passages")
    later = got.select("doc_id", "start", "end", F.col("source_id").alias("other_id"), F.col("source_start").alias("other_start"), F.col("source_end").alias("other_end"), F.lit(False).alias("first"), "class_id")
    return later.union(got.select("source_id", "source_start", "source_end", "doc_id", "start", "end", F.lit(True), "class_id"))


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import cut
    from .quality_rules import judge, rule_stats

    stats = cut(rule_stats(table(spark, sf_dir, "documents")), "stats")
    return judge(stats, table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import prefix_counts

    return prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1))


def op11_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.mine_negatives(table(spark, sf_dir, "embeddings"), label=label)


QUERIES = {f.__name__: f for f in (op1_toxicity_kneser_ney, op2_compact_windows, op3_chat_snapshots, op4_ngram_jaccard, op5_winnowing, op6_quality_rules, op7_prefix_token_counts, op8_pu_quality, op9_best_fit_packing, op10_token_files, op11_simhash_anchors, op12_lexical_search, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op3_chat_snapshots": chat.SQL, "op12_lexical_search": lexical.SQL, "op13_hard_negatives": mining.SQL}
