"""A corpus pipeline over ``documents``: drop poor pages, remove copies, pack what stays.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is written
as Parquet and reread as the next stage's docs.

Defined cases, for every stage: an empty table gives an empty one; further columns, whatever their
names, stay with their rows (but for packing, which returns its own); very long texts are read whole.
Rows with a null doc_id and rows that share one are documents like any other; what a stage
decides about a null or empty text is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tollgate.llm import common, exact_dedup, packing, quality, simhash, substring_dedup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go.

    Null and empty texts are scored like others; rows without a doc_id stay, as no decision can name them;
    of rows that share a doc_id all go if one is rejected."""
    common.prepare(spark)
    return quality.kept_documents(docs, common.table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest doc_id stays.

    Null counts as empty; a null doc_id is the smallest; of rows that share text and doc_id one stays."""
    common.prepare(spark)
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 3-word SimHashes are linked at 2 or fewer bits, the one with the smallest doc_id stays.

    Texts without a word are linked to each other; ties are one document."""
    common.prepare(spark)
    return simhash.kept_documents(docs, width=3, radius=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a smaller document holds too are cut; every document stays.

    Null text stays null; a null doc_id is smaller than any other."""
    common.prepare(spark)
    return substring_dedup.without_repeats(docs, window=13)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 along a Hilbert curve: one row per piece, with its ids.

    Null and empty texts are their end id alone; repeated rows are packed each."""
    common.prepare(spark)
    return packing.pack(docs, TOKENIZER, end=1, length=2048)


STAGES = [("quality", drop_poor), ("exact_dedup", drop_exact_copies), ("simhash", drop_near_copies),
          ("substring_dedup", cut_repeats), ("packing", pack)]

# Learned scores and tokenizer ids are outside SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and reread."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
