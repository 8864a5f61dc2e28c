"""A corpus pipeline of five stages over documents; each stage's output is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echolith.llm import decontaminate, exact_dedup, langid, sentencepiece_bpe, simhash
from echolith.llm.shared import remove_tables, shared_table, tables_mark


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown, or not recognised, go."""
    return langid.drop_unrecognised(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark occurs go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, as SentencePiece ids: doc_id, n_pieces, lossless, ids."""
    return sentencepiece_bpe.encode(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("SentencePiece", pieces),
]

#: The stages rank n-grams, verify matches and merge pieces in Python, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What a stage read and worked with is removed once its output is written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_mark(spark)
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove_tables(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
