"""A training corpus from raw documents: four stages, each a Parquet table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessergraph.llm.common import documents, save
from tessergraph.llm.ngram_join import drop_near_duplicates
from tessergraph.llm.packing import pack_documents
from tessergraph.llm.pii import mask_documents
from tessergraph.llm.toxicity import drop_toxic


# All stages take null ids and texts, empty and very long texts, repeated rows, empty tables and further columns of any
# name; what each gives for them is said at its operator and, in short, here.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that a classifier, fitted on a bounded sample of the labelled ones, calls toxic. Null texts and scores
    right at the threshold stay; all columns and repeats are kept."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group that the n-gram Jaccard join connects. Null ids, null texts and
    texts without a word stay; repeats of a row are reduced to one; all columns are kept."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts, row for row, with all columns; ``n_chars`` follows."""
    return mask_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of documents for training, of at most 2048 BPE tokens. Rows with a null id or no token are in none; repeated rows
    are packed each for itself; long documents are cut, never shortened."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("packing", packing),
]

#: SQL can express neither the classifier nor differencing; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; an empty one gives no windows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
