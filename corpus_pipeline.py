"""From raw documents to packed sequences: quality rules, near duplicates, repeated strings, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again before the next stage. All but the
last return the columns of documents. Executors need no local files; the tokenizer's definition is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewell.core import materialize, ship_package
from scorewell.llm import near_duplicates, packing, quality_rules, repeats, secret_scan

NEAR_PERCENT, NEAR_WORDS = 80, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules for texts and hosts."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 80 percent of five-word shingles."""
    ship_package(spark)
    return near_duplicates.keep_first(docs, NEAR_PERCENT, NEAR_WORDS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document holds are taken out of the texts."""
    ship_package(spark)
    return repeats.cut(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts are masked."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences."""
    import public_tokenizers

    ship_package(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return packing.pack(docs, file.read())


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("secret_scan", secrets), ("packing", pack)]

# Tokenising and packing have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
