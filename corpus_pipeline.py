"""The corpus pipeline: five training-data operators in a row.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientele.llm import decontaminate, mixing, quality, simhash, token_files
from clientele.llm.common import stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """8: documents above their language's perplexity threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """3: of each near-duplicate component one document stays (three-word shingles, two bits)."""
    return simhash.deduplicate(docs, shingle=3, radius=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """10: documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """6: the toxic domain is mixed down to nothing; the other domains are to
    grow, but no document may be repeated, so they stay whole."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), mixing.multiples(clean=1.3, low=1.3, toxic=0.0), max_rate=1.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: token ids in packed files, read back."""
    return token_files.write_and_read(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

ORACLE_SQL = None  # the classifiers and the tokenizer cannot be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name)
    return docs
