"""Corpus pipeline: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of ``documents``, extra columns included. Every stage takes an empty
table (and returns one), null and repeated ids, and rows equal in all columns, as its docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plaudit.llm import byte_bpe, cube_mix, ngram_join, pii_weak, quality_mil
from plaudit.llm.common import Kept

#: Model stages have no SQL form; tests/llm/test_pipeline.py compares each stage with brute force on what its predecessor kept.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier rejects go.

    A null or empty text is judged as one passage of zeros. Repeated rows are judged each, alike. Without labels of both
    classes nothing goes."""
    return quality_mil.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near copies stays (five words, similarity of 0.8 or more).

    Rows equal in id and text are one; rows that share or lack an id are told apart by their text. Texts without words, null
    ones included, link with nothing and all stay."""
    return ngram_join.one_per_group(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data is replaced by its kind. No row goes; a null or empty text stays as it is; repeated rows are changed alike."""
    return pii_weak.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as often as the mix of sources takes it.

    A null source is a source of its own; a text without words, null ones included, is not taken; of rows equal in all
    columns one stands for the copies of all."""
    return cube_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of every text, with digests, a row for each row. A null or empty text has no ids."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table is deleted once the next one's is written."""
    docs, kept, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Kept(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = kept.keep(stage(spark, docs, sf_dir), name)
        kept.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
