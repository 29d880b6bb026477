"""Registered queries of the training-data operators: production parameters, whole tables, result digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.llm import (ann_crosspoly, byte_bpe, chat_fsm, chat_repair, cube_mix, html_suffix, langid_kn, ngram_join, pii_weak, quality_mil,
                         rules_weak, suffix_dedup, token_align)
from plaudit.llm.common import Kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_mil.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op2_language_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_kn.identify_languages(table(spark, sf_dir, "documents"))


def op3_chat_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_fsm.read_back(chat_fsm.format_chats(turns))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op5_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_weak.find_personal_data(table(spark, sf_dir, "documents"), Kept(spark, "pii"))


def op6_rules_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = rules_weak.score_rules(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_crosspoly.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = cube_mix.cube_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_html_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_suffix.extract(table(spark, sf_dir, "pages"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_align.align_documents(table(spark, sf_dir, "documents"), *paths, Kept(spark, "align"))


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_digest(chat_repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_mil, op2_language_kn, op3_chat_fsm, op4_byte_bpe, op5_pii_weak, op6_rules_weak, op7_cross_polytope, op8_ngram_join,
                                    op9_cube_mix, op10_suffix_dedup, op11_html_suffix, op12_token_align, op13_chat_repair)}


def oracle_sql() -> dict[str, str]:
    return {}
