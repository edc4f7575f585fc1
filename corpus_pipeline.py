"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame; all but the last return the columns of documents. run() writes each stage to the shared
folder and reads it again for the next, so a lost executor never costs more than part of a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import decontamination, exact_dedup, packing, quality, set_join
from voxlake.llm._core import written
from voxlake.llm._defaults import default_tokenizer, fold
from voxlake.session import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; labels of the held-out fold are not learned from."""
    labels = read_table(spark, sf_dir, "labels")
    model = quality.train(spark, docs, labels.where(fold("doc_id", 4) != 2), labels)
    return quality.keep_good(spark, docs, model)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return set_join.keep_one(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no verified window of any benchmark item occurs."""
    return decontamination.decontaminate(spark, docs, read_table(spark, sf_dir, "benchmark"), least_items=1)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(spark, docs, default_tokenizer(), added_tokens=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_deduplication", exact_deduplication),
    ("near_deduplication", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sequence_packing", sequence_packing),
]

#: A trained classifier, connected components and a tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, name)
    return docs
