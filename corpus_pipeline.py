"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and returns a DataFrame. ``run`` writes the result of each as
Parquet in the shared folder and reads it again for the next. All stages but the last return the columns of ``documents``; nulls, empty texts,
repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup, jaccard_join, packing, quality, substring_dedup
from tidewright.llm.queries import tokenizer_file
from tidewright.session import cut_lineage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: five-word shingles, similarity of at least 0.8."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that stand elsewhere too go; n_chars follows the text."""
    return substring_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: a row per piece, with its ids."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: A learned classifier and a tokenizer are beyond SQL; the tests follow the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
