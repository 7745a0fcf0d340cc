"""The dealt operators over whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm import (chat_format, decontaminate, lexical_search, mixing, ngram_join, prefix_trie, quality_rules, repeats, secret_scan, sharding,
                           token_counts, token_files, warc)
from baitwatch.llm.common import stage


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    return secret_scan.scan(_documents(spark, sf_dir), F.col("source"), F.col("doc_id"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), [1024])
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"),
                         F.get("fits", F.lit(0)).alias("fits_1024"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(_documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(spark, folder, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.digests(spark, folder)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rows = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.allot(rows, F.col("doc_id"), F.col("source")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules
    return q.ledger(_documents(spark, sf_dir)).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        q.rejected_by("v1").alias("base_failed"), (~q.rejected_by("v2")).alias("kept"), "bits")


# Says what the marks of templates say.
PLANTED = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of which both turns say control strings."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return chat_format.digests(talks.union(planted)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stage(prefix_trie.chains(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie.trie(prefix_trie.regrafted(turns))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_repeats": op3_repeats,
    "op4_warc": op4_warc,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_files": op6_token_files,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_rules": op10_quality_rules,
    "op11_chat_format": op11_chat_format,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}
