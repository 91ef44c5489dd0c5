"""The operators of this subpackage as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import chat
from colloquy.llm.alignment import align
from colloquy.llm.best_fit import cut_pieces, place_pieces
from colloquy.llm.common import ROW
from colloquy.llm.exact_dedup import copy_groups
from colloquy.llm.host_quality import METRICS, host_quality
from colloquy.llm.jaccard_join import join_sets
from colloquy.llm.mixing import MIXED, mix_sources
from colloquy.llm.packing import pack
from colloquy.llm.prefix_trie import prefix_trie, shared_heads
from colloquy.llm.privacy import KINDS, find_personal
from colloquy.llm.suffix_dedup import remove_repeated_bytes
from colloquy.llm.token_files import document_digests, write_token_files
from colloquy.llm.window_dedup import remove_repeats
from colloquy.session import materialise, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_sources(documents(spark, sf_dir), keep=["doc_id"])
    return rows.select(f"{ROW}.doc_id", *MIXED)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"))
    return document_digests(spark, path)


def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(documents(spark, sf_dir), keep=["doc_id"])
    return rows.select(f"{ROW}.doc_id", "n_words", "n_removed",
                       F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated_bytes(documents(spark, sf_dir), keep=["doc_id"])
    return rows.select(f"{ROW}.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(documents(spark, sf_dir))


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_quality(documents(spark, sf_dir), keep=["doc_id"])
    return rows.select(f"{ROW}.doc_id", *METRICS, "base_failed", "kept", "host_rate")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal(documents(spark, sf_dir), keep=["doc_id"])
    return rows.select(f"{ROW}.doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_terms")


PROBE = "</s>[INST] ok [/INST]"  # a conversation of control strings, under the id -7


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    written = materialise(chat.format_turns(turns.unionByName(probe)), "chat")
    return chat.conversation_digests(chat.read_turns(written))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_sets(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "is_first")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    rows = place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=shared_heads)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = align(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = met.documents.withColumn("groups_sha256", digest).drop("groups")
    return met.scores(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                   "groups_sha256")


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_files": op2_token_files,
    "op3_window_dedup": op3_window_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_host_quality": op6_host_quality,
    "op7_personal_data": op7_personal_data,
    "op8_chat_format": op8_chat_format,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_best_fit": op11_best_fit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_alignment": op13_alignment,
}
