"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept; its rows are written as
Parquet in the shared folder and read again. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mandatewatch.llm import byte_convnet, jaccard_regions, line_dedup, residual_packing, substring_dedup
from mandatewatch.llm.common import table, written

def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents of no language go, and noise.

    A text goes that is null or has no letter, or whose windows, four at least,
    the network takes for encoded or shuffled text rather than for any language.
    A low score alone rejects nothing: short clean texts next to a licence line
    score as low as any.
    """
    return byte_convnet.keep_known(docs, byte_convnet.train(docs, noise=True))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: a line found in several documents stays in the first; its text changes, every document stays."""
    return line_dedup.without_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words at 0.8 or more: one document of each group stays."""
    return jaccard_regions.one_per_group(docs, 5, 80)


def unique_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words in passages of 35 or more that stand elsewhere go; every document stays."""
    return substring_dedup.without_repeats(docs, 35)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens: a row per piece."""
    return residual_packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("ngram_jaccard", one_of_each),
    ("substring_dedup", unique_passages),
    ("packing", packed),
]

#: SQL can express neither the trained network nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
