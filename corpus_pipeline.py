"""The training-corpus pipeline: five stages over `documents`, each written as Parquet and read again.

1. language: documents without a language (no letters), or of which less than half can be told, go.
2. lines: repeated and nearly repeated lines go; a document of which no line is left goes.
3. near_duplicates: one document (the smallest doc_id) of each group that shares 0.8 of its five-word shingles stays.
4. decontamination: documents that contain a window of a benchmark item go.
5. packing: the rest is packed into sequences of 4096 tokens; rows are pieces, as in op5.

Rows: a null or blank text has no language and goes in the first stage. Null and repeated ids are documents of their
own by their texts; repeated rows are near-duplicates of each other, so one stays. The first four stages return all
columns of their input, whatever their names, and change text and n_chars only. An empty table gives no rows.

Where the session sets no size of Arrow batches, the first two stages set one (16 MB) that stays: their Python runs when
the caller writes what they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lenswork.llm import decontamination, language, lines, near_duplicates, packing
from lenswork.llm.common import keep_batches_small, load, stored

LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep_batches_small(spark)
    return language.keep_known(docs, language.learn(docs), LEAST_LANGUAGE_SCORE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep_batches_small(spark)
    return lines.drop_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark"), remove="documents")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't state language identification and packing; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
