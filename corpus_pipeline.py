"""A corpus pipeline: each stage works on all that its predecessor kept.

Rejected documents go, of equal and of nearly equal texts one stays, documents that hold benchmark items go, and what is
left becomes token sequences.

Defined results: a null or empty text is a document without words, which the classifier weighs 0; equal texts, a null
doc_id, repeated rows, empty tables and columns of other names are treated as each stage's operator says. All stages but
the last keep the columns of documents. Without labels, and where they part nothing, the first stage keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from benchtide.llm import decontaminate, exact_dedup, jaccard, packing, quality
from benchtide.llm.common import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier draws."""
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: links are a similarity of 0.8 or more of their sets of five-word shingles."""
    return jaccard.dedup(docs, words=5, percent=80)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", unseen),
    ("packing", packed),
]

#: The classifier's weights and the tokenizer's ids have no SQL form; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))  # later stages read their input several times
    return STAGES[-1][1](spark, docs, sf_dir)
