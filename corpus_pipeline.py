"""From raw documents to packed training sequences: each stage applies one operator to all that its predecessor kept.

Defined cases: null and empty texts are clean, are near copies of each other (one row of them stays), have nothing to
remove, are never taken by the mix and so do not reach the packing. Null ids go through like others; where copies are
to choose from, a null id stays only if there is no other. Equal rows are copies. Texts of any length are taken whole.
Columns beside those of documents are carried up to the last stage, whatever their names. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import op4_toxicity, op6_similar, op7_mixing, op9_suffix, op10_packing
from siftline.llm.storage import bounded_batches, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the counterfactual-regularised classifier rejects."""
    bounded_batches(spark)
    return op4_toxicity.clean(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    bounded_batches(spark)
    return op6_similar.representatives(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of over 50 words that repeat anywhere; n_chars is counted anew."""
    bounded_batches(spark)
    return op9_suffix.shortened(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return op7_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins and texts."""
    return op10_packing.pack(docs, texts=True)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", suffix_array),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: SQL can express none of the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else written(docs)
    return docs
